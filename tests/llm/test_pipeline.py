"""The pipeline's stages on a small corpus, and the registered queries against their SQL."""

import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from inkmill.llm import mixing, ngrams, packing, registry

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels")


def corpus(tmp_path, spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioubcdf") for _ in range(rng.randint(3, 8)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(120)]
    docs = [(i, t + "\nfooter on all sites" * (i % 2), "en", f"s{i % 7}", len(t), 0.5) for i, t in enumerate(clean)]
    docs += [(500 + i // 12, " ".join(clean[i].split()[:-2] + [word()]), "en", f"s{i % 7}", 1, 0.1) for i in range(0, 120, 12)]
    docs += [(600 + i, "vilest " + t + " awfully hateful", "en", "s1", 1, 0.1) for i, t in enumerate(" ".join(word() for _ in range(60)) for _ in range(40))]
    docs += [(None, None, None, None, None, None), (700, "", "en", "s1", 0, 0.0), (701, None, "en", None, 0, 0.0), (3, docs[3][1], "en", "s3", 1, 0.5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(600 + i, 1, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    rows = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    toxic = {r.doc_id for r in out["toxicity"].collect()}
    assert not any(i in toxic for i in range(600, 640)) and toxic >= {*range(120), 500, 700, 701, None}
    stripped = out["line_dedup"].collect()
    assert len(stripped) == out["toxicity"].count() and sum("footer" in (r.text or "") for r in stripped) == 1
    assert all(r.n_chars == len(r.text) for r in stripped if r.doc_id is not None and r.doc_id % 2 and r.doc_id > 3 and r.doc_id < 120)
    kept = Counter(r.doc_id for r in out["near_duplicates"].collect())
    assert set(kept) == {*range(120), None, 700, 701} and not any(500 <= i < 600 for i in kept if i)
    mixed = Counter(r.doc_id for r in out["mixing"].collect())
    want = Counter({r.doc_id: 0 for r in out["near_duplicates"].collect()})
    keyed = mixing.measured(out["near_duplicates"])
    for r in mixing.mix(keyed, mixing.plan(keyed)).collect():
        want[r.doc_id] += r.copies
    assert +want == mixed
    packed = out["packing"].toPandas()
    words = Counter()
    for r in out["mixing"].collect():
        words[r.doc_id] += len((r.text or "").split())
    assert packed.groupby("doc_id")["size"].sum().to_dict() == {k: v for k, v in words.items() if k is not None}
    assert (packed.groupby("bin")["size"].sum() <= packing.CAPACITY).all()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed) and rows


def test_near_duplicates_go_by_text_and_repeated_rows_are_one(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    near = texts[0] + " more"
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (6, near), (6, texts[2]), (7, texts[3]), (7, texts[3]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert Counter(map(tuple, out.collect())) == Counter([(1, texts[0]), (5, texts[1]), (6, texts[2]), (7, texts[3]), (None, None)])


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score int, spans string, n_removed int, _text string, size int, seed string, copies int, component_id int, bin int"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    row = (1, "one two three\nfour", "en", None, 3, 7, "a", 8, "b", 9, "c", 10, 11, 12)
    for n, rows in enumerate(([], [row, row, (None,) * 14, (2, "", *row[2:])])):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
                assert all(r.score in (7, None) and r.size in (9, None) and r.n_removed in (8, None) for r in out.collect())
            out.write.parquet(f"{tmp_path}/{n}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
        assert bool(docs.count()) == bool(rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_give_the_rows_of_their_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.QUERIES[name](spark, SF)
    result = db.execute(registry.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    want = Counter(tuple(dict(zip(columns, r)).get(c) for c in found.columns) for r in result.fetchall())
    assert Counter(tuple(r) for r in found.collect()) == want


def test_queries_without_sql_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    found = {k: registry.QUERIES[k](spark, SF).toPandas() for k in ("op3_shard_bytes", "op4_toxicity", "op7_quality_rules", "op9_ngram_jaccard_join", "op10_best_fit_packing")}
    assert all(x["doc_id"].nunique() == n for x in found.values())
    sets = {r.doc_id: set(ngrams.grams(r.text).tolist()) for r in docs.collect()}
    links = Counter(i for i in sets for j in sets if i != j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    near = found["op9_ngram_jaccard_join"].set_index("doc_id")["n_links"].to_dict()
    assert near == {i: links[i] for i in sets}
    bytes_ = found["op3_shard_bytes"].groupby("shard")["size"].sum()
    assert set(bytes_.index) == set(range(24)) and found["op4_toxicity"]["score"].between(0, 1).all()


def test_the_entry_has_all_queries():
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in __spark_entry__.queries() if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in __spark_entry__.queries()
