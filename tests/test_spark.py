"""Stages, native expressions against the pure functions, knowledge bases, sinks, SQL and streaming."""

import hashlib
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from inkmill import sql
from inkmill.functions import markdown, native, pii, plain, tokens
from inkmill.operators import sheets, stages
from inkmill.options import Options
from inkmill.plans import api, kb, queries_documents, registry
from inkmill.sources import readers, writers
from inkmill.streaming import ingest

DIRTY = ["a  \n\n\n\nPage 3 of 9\n***\n---\n• b\n- \n<!-- x\n-->\n<p> </p>z", "", "x\n- a\n\n- b\n\n- c\n\n- d\n---\n", "  | a |  b |\n| :- | -: |\n|1|  2 |\n", "é  \n12/40\nfin"]


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(DIRTY)], "i int, t string")


def test_native_rules_equal_the_functions(spark, dirty):
    rows = dirty.select(
        "t", native.strip_boilerplate(F.col("t")).alias("b"), native.compact_tables(F.col("t")).alias("c"), native.fenced(F.col("t"), F.lit("x")).alias("f"),
        native.words(F.col("t")).alias("w"), native.utf16(F.col("t")).alias("u"), native.estimate_tokens(F.col("t")).alias("e"), native.title_of(F.col("t"), F.lit("n.md")).alias("n"),
        native.description_of(F.col("t")).alias("d"), native.body_of(F.col("t")).alias("o"), native.image_alts(F.col("t")).alias("a"),
    ).collect()
    for r in rows:
        meta = markdown.metadata(r.t or " ", "n.md")
        assert r.b == markdown.strip_boilerplate(r.t) and r.c == markdown.compact_tables(r.t) and r.f == plain.fence(r.t, "x")
        assert r.w == tokens.count_words(r.t) and r.e == tokens.estimate(r.t) and r.o == markdown.split_frontmatter(r.t)[1]
        assert r.d == meta["description"] and r.a == r.t
        assert r.n == (meta["title"] if r.t else "n")


def test_native_checksums_equal_the_functions(spark):
    values = ["4532015000000007", "4532015000000004", "FR7630006000011234567890189", "fr76 3000 6000 0112 3456 7890 189", "185127510804279", "185127510804299", "1851275108042", "x"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", native.luhn(F.col("v")).alias("l"), native.iban(F.col("v")).alias("i"), native.nir(F.col("v")).alias("n")).collect()
    for r in rows:
        assert (r.l, r.i, r.n) == (pii.luhn(r.v), pii.iban(r.v), pii.nir(r.v))


def test_nulls_and_empty_texts_in_stages(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "# A\n\nx")], "i int, t string")
    rows = df.select("i", stages.optimize(F.col("t"), F.lit("f.md")).alias("o"), stages.anonymize(F.col("t")).alias("a"), stages.chunk(F.col("t"), F.lit("d"), F.lit(None).cast("string")).alias("c"), stages.structure(F.col("t"), F.lit(None).cast("string")).alias("s")).orderBy("i").collect()
    assert [r.o.markdown for r in rows] == ["", "", "# A\n\nx"] and [len(r.c) for r in rows] == [0, 0, 1]
    assert [r.a.total for r in rows] == [0, 0, 0] and rows[0].s.lines == 1 and rows[2].c[0].doc_title == "Document"


def test_unused_stages_are_pruned(spark, dirty):
    docs = dirty.select(F.col("i").cast("long").alias("ord"), F.concat(F.col("i").cast("string"), F.lit(".md")).alias("filename"), F.col("t").alias("markdown"))
    plan = kb.process(docs).select("ord", "markdown")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


DOCS = [
    (0, "readme.docx", "# Readme\n\nPremier document. M. Jean Dupont.\n\n## Suite\n\nTexte."),
    (1, "readme.pdf", "Second document sans titre, a@b.fr."),
    (2, "sub/readme-2.md", "# Trois [x]\n\nTexte."),
    (3, None, "x"),
    (4, "none.md", None),
]


def test_knowledge_base(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "ord long, filename string, markdown string")
    base = kb.build(docs, Options(anonymize=True, title="Base"))
    names = [r.filename for r in base.documents.orderBy("ord").collect()]
    assert names == ["readme.md", "readme-2.md", "readme-2-2.md"]
    chunks = base.chunks.orderBy("ord", "chunk_index").collect()
    assert [c.id for c in chunks] == ["readme_chunk_1", "readme_chunk_1", "readme-2_chunk_1"] and "Dupont" not in chunks[0].content
    m = base.manifest.first()
    assert (m.document_count, m.total_entities, m.total_chunks, m.context_strategy.strategy) == (3, 2, 3, "full_context")
    archive = zipfile.ZipFile(io.BytesIO(writers.zip_knowledge_base(base)))
    assert set(archive.namelist()) == {"llms.txt", "llms-full.txt", "llms-small.txt", "rag-chunks.jsonl", "manifest.json", "docs/readme.md", "docs/readme-2.md", "docs/readme-2-2.md"}
    index = archive.read("llms.txt").decode()
    assert index.startswith("# Base\n\n> ") and "- [Trois x](docs/readme-2-2.md): " in index and "a@b.fr" not in index
    assert "## Document 2: " in archive.read("llms-full.txt").decode() and "### 3. Trois [x]" in archive.read("llms-small.txt").decode()
    assert len(archive.read("rag-chunks.jsonl").decode().split("\n")) == 3
    assert json.loads(archive.read("manifest.json"))["files"][0]["original_filename"] == "readme.docx"
    writers.write_folder(base, str(tmp_path / "kb"))
    assert spark.read.json(str(tmp_path / "kb/rag-chunks.jsonl")).count() == 3


def test_names_of_large_families_are_distinct_too(spark):
    given = ["a.md", "a.md", "a-2.md", "a.md", "b.md", "a-2.md", "b.md", "a-2-7.md", "c.md"]
    docs = spark.createDataFrame(list(enumerate(given)), "ord long, filename string")
    exact = [r.filename for r in kb.distinct_names(docs).orderBy("ord").collect()]
    assert exact == ["a.md", "a-2.md", "a-2-2.md", "a-3.md", "b.md", "a-2-3.md", "b-2.md", "a-2-7.md", "c.md"]
    large = [r.filename for r in kb.distinct_names(docs, most=1).orderBy("ord").collect()]
    assert len(set(large)) == len(given) and large[0] == "a.md" and large[1] == "a-9.md" and large[6] == "b-2.md"


def test_names_are_the_first_free_ones_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(kb, "FAMILY", 1)
    monkeypatch.setattr(kb, "RANGE", 7)
    rng = random.Random(9)
    names = [rng.choice(["a", "a", "b", "ab"]) + "".join(f"-{rng.choice([0, 2, 2, 3, 4, 5, 7, 12, '02'])}" for _ in range(rng.choice([0, 0, 1, 1, 2]))) + ".md" for _ in range(400)]
    small = ["a.md", "a.md", "a-2.md", "a.md", "b.md", "a-2.md", "b.md", "a-2-7.md", "c.md"]
    for given in (small, names, [f"p-{i}.md" for i in range(2, 40)] + ["p.md"] * 30, ["p.md"] * 30 + [f"p-{i}.md" for i in range(40, 1, -1)]):
        used, want = set(), []
        for name in given:
            new, n = name, 2
            while new in used:
                new, n = f"{name.removesuffix('.md')}-{n}.md", n + 1
            used.add(new)
            want.append(new)
        docs = spark.createDataFrame(list(enumerate(given)), "ord long, filename string")
        assert [r.filename for r in kb.distinct_names(docs).orderBy("ord").collect()] == want


def test_empty_knowledge_base(spark):
    base = kb.build(spark.createDataFrame([], "ord long, filename string, markdown string"))
    lines = [r.line for r in base.lines.filter("file = 'llms.txt'").orderBy("section", "number").collect()]
    assert lines[-1] == kb.EMPTY and base.manifest.first().document_count == 0


def test_context_strategy_boundary():
    assert kb.strategy(200_000)["strategy"] == "full_context" and kb.strategy(200_001)["file"] == "rag-chunks.jsonl"


def test_files_are_converted_one_by_one(spark, tmp_path):
    for name, content in (("a.md", "# A\n\nété"), ("b.doc", "x"), ("c.html", "<h1>C</h1>")):
        (tmp_path / name).write_text(content)
    done = {r.filename: r for r in kb.convert(readers.read_files(spark, str(tmp_path))).collect()}
    assert done["a.md"].markdown == "# A\n\nété" and done["c.html"].markdown == "# C" and "(.doc)" in done["b.doc"].error
    economy = kb.batch_economy(kb.process(kb.convert(readers.read_files(spark, str(tmp_path))).filter("error is null"))).first()
    assert economy.original_tokens > 0


def test_redaction_shows_the_whole_text(spark):
    rows = queries_documents._personal(spark, "/root/testdata/sf0.001").select("doc_id", "text").collect()
    want = {r.doc_id: hashlib.md5(pii.anonymize(r.text, "redact")["text"].encode()).hexdigest() for r in rows}
    found = {r.doc_id: r.text_md5 for r in queries_documents.pii_redact(spark, "/root/testdata/sf0.001").collect()}
    assert found == want and any(len(r.text) > 80 for r in rows)


def test_requests(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\nMail a@b.fr  \n\n\n\nfin")
    (tmp_path / "b.doc").write_text("x")
    done = {r.original_filename: r for r in api.convert(readers.read_files(spark, str(tmp_path)), {"anonymize": "true", "level": "ultra_compact"}).collect()}
    assert done["a.md"].success and "[EMAIL_1]" in done["a.md"].markdown and done["a.md"].stats.tokens > 0 and len(done["a.md"].chunks) == 1
    assert not done["b.doc"].success and done["b.doc"].markdown is None
    texts = spark.createDataFrame([(1, None, "# T\n\nx  "), (2, "n.md", None)], "ord long, filename string, markdown string")
    once = api.optimize_text(texts, {"injectFrontmatter": True}).first()
    again = api.optimize_text(spark.createDataFrame([(1, "document.md", once.markdown)], texts.schema), {"injectFrontmatter": True}).first()
    assert again.markdown == once.markdown and again.savings.tokens_saved == 0 and again.chunks[0].id == once.chunks[0].id
    assert api.analyze_markdown(texts.filter("ord = 1")).first().stats.headers == 1
    assert api.analyze_markdown(texts.filter("ord = 1")).first().html == "<h1>T</h1>\n<p>x</p>"
    results = api.convert(readers.read_files(spark, str(tmp_path)))
    assert api.batch_economy(results).first().original_tokens > 0 and len(zipfile.ZipFile(io.BytesIO(api.download_zip(results))).namelist()) == 1
    assert api.preview(results).count() == 2 and api.status(spark).count() == 1
    assert api.export_jsonl(kb.chunks_of(results.filter("success"))).count() == 1 and api.knowledge_base(texts).total_tokens > 0
    assert api.estimated(texts).filter("ord = 1").first().tokens == 3


def test_sheets_of_rows(spark):
    rows = spark.createDataFrame([(1, ["a|b", "x\ny"]), (2, [" ", ""]), (3, ["c"])], "row_no long, cells array<string>")
    assert [r.line for r in sheets.sheet_rows(rows, ["k", ""]).orderBy("row_no").collect()] == ["|k|Col_2|", "|---|---|", "|a\\|b|x y|", "|c||"]
    assert [r.line for r in sheets.sheet_rows(rows, ["k", ""], "records", 1).orderBy("row_no").collect()][-1].startswith("> ⚠️ *Table tronquée: 1 lignes")


def test_zip_names_are_safe_and_distinct():
    names = zipfile.ZipFile(io.BytesIO(writers.zip_files([("../../a.md", "1"), ("x/a.md", "2"), ("", "3")]))).namelist()
    assert names == ["a.md", "a-2.md", "document"]


def test_sql_functions(spark):
    sql.register(spark)
    assert spark.sql("select count_tokens('un deux') n, anonymize_text('a@b.fr', 'mask') a, optimize_markdown('a  ', 'clean') o, html_to_markdown('<h1>x</h1>') h").first().asDict() == {"n": tokens.count_tokens("un deux"), "a": "[EMAIL]", "o": "a", "h": "# x"}
    assert spark.sql("select * from chunk_markdown('# A\n\nx', 'd', 'A', 100)").first().id == "d_chunk_1"


def test_streaming_gives_the_chunks_of_the_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.md").write_text("# A\n\nTexte un.")
    (source / "b.md").write_text("# B\n\nTexte deux.")
    query = ingest.start(ingest.stream_chunks(ingest.stream_files(spark, str(source))), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a_chunk_1", "b_chunk_1"}


def test_token_stage_and_capabilities(spark):
    ids = spark.createDataFrame([("été 😀",)], "t string").select("t", stages.encode(F.col("t")).alias("i"))
    assert ids.select(stages.decode(F.col("i")).alias("d")).first().d == "été 😀"
    assert len(kb.capabilities(spark).first().pricing) == 7


def test_entry_and_registry(spark):
    assert set(registry.ORACLES) <= set(registry.QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_workers_find_the_package_from_anywhere(tmp_path):
    """The driver's own folder needn't be the repository: queries send the package to the workers."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\nimport __spark_entry__ as e\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print('ROWS', e.queries()['html_to_markdown'](s, '/root/testdata/sf0.001').count(), e.entry(s).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 50 " in out.stdout, out.stderr[-2000:]
