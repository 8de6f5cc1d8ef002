"""Sections, merging, packing and records."""

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from inkmill.functions import chunks as c
from inkmill.functions.tokens import count_tokens

GUIDE = "# Guide\n\nIntro du guide.\n\n## 1. Installation\n\nInstaller le paquet.\n\n## 2. Configuration\n\n### 2.1 Variables\n\nPORT=3000\nHOST=local\n\n## 3. Usage\n\nLancer.\n"


def test_sections_and_breadcrumbs():
    out = c.chunk(GUIDE, "guide", "Guide", least=0)
    assert [x["title"] for x in out] == ["Guide", "1. Installation", "2.1 Variables", "3. Usage"]
    assert out[0]["breadcrumbs"] == ["Guide"] and out[2]["breadcrumbs"] == ["Guide", "2. Configuration", "2.1 Variables"]
    assert [x["id"] for x in out] == [f"guide_chunk_{i}" for i in range(1, 5)]


def test_small_sections_merge_under_their_common_parent():
    out = c.chunk("# Guide\n\n## Contact\n\na\n\n## Horaires\n\nb\n\n## Adresse\n\nc", "g", "Guide")
    assert len(out) == 1 and out[0]["breadcrumbs"] == ["Guide"] and out[0]["title"] == "Contact"
    assert len(c.chunk("# Guide\n\n## Contact\n\na\n\n## Horaires\n\nb\n\n## Adresse\n\nc", "g", "Guide", least=0)) == 3


def test_trailing_small_section_folds_back_and_the_maximum_holds():
    body = "Voici une phrase simple. " * 30
    out = c.chunk(f"# D\n\n## A\n\n{body}\n\n## B\n\n{body}\n\n## C\n\nOK.", "d", "D", most=300)
    assert out[-1]["content"].endswith("OK.") and all(x["token_count"] <= 300 for x in out)


def test_small_lead_goes_in_front_of_a_large_table():
    rows = "\n".join(f"| ligne {i} | valeur {i} |" for i in range(120))
    out = c.chunk(f"# T\n\nPetit.\n\n## Table\n\n| a | b |\n|---|---|\n{rows}", "t", "T", most=200)
    assert out[0]["content"].startswith("# T\n\nPetit.")
    body = [x for x in out if "ligne" in x["content"]]
    assert all("| a | b |\n|---|---|" in x["content"] for x in body)
    assert len(set(re.findall(r"ligne \d+", "\n".join(x["content"] for x in out)))) == 120
    assert all(x["token_count"] <= 205 for x in out)


def test_giant_paragraph_is_cut_into_numbered_parts():
    out = c.chunk("Cette phrase se répète sans fin. " * 200, "p", "P", most=120)
    assert out[1]["title"] == "P (Partie 2)" and all(x["token_count"] <= 125 for x in out)


def test_overlap_by_units_and_by_sentences():
    paragraphs = "\n\n".join(f"Paragraphe {i} avec quelques mots." for i in range(60))
    out = c.chunk(paragraphs, "o", "O", most=200, overlap=60)
    assert out[1]["content"].split("\n\n")[0] in out[0]["content"]
    sentences = "\n\n".join(" ".join(f"Phrase {i}.{j} assez longue pour compter un peu." for j in range(6)) for i in range(12))
    some, none = c.chunk(sentences, "s", "S", most=200), c.chunk(sentences, "s", "S", most=200, overlap=0)
    assert some[1]["content"].split(". Phrase")[0] in some[0]["content"]
    assert none[1]["content"].split("\n\n")[0] not in none[0]["content"]


def test_code_isnt_a_heading_and_stays_fenced():
    assert len(c.chunk("# A\n\n```bash\n# commentaire\nls\n```", "c", "A", least=0)) == 1
    code = "```py\n" + "\n".join(f"x{i} = {i}" for i in range(200)) + "\n```"
    out = c.chunk(code, "c", "C", most=100)
    assert len(out) > 1 and all(x["content"].startswith("```py") and x["content"].endswith("```") for x in out)


def test_ids_follow_the_content():
    assert c.content_id("abc") == "doc_ba7816bf8f01"
    assert c.chunk("abc")[0]["id"] == "doc_ba7816bf8f01_chunk_1" and c.chunk(" \n") == c.chunk(None) == []


def test_limits():
    assert c.Limits.of() == c.Limits(600, 90, 150) and c.Limits.of(10) == c.Limits(32, 5, 32)
    assert c.Limits.of(100, 0, 0) == c.Limits(100, 0, 0) and c.Limits.of(100, 90).overlap == 50


def test_records_accept_both_spellings():
    new = c.chunk(GUIDE, "g", "Guide", least=0)[1]
    record = json.loads(c.jsonl(new))
    assert list(record) == ["id", "doc_id", "doc_title", "chunk_index", "title", "breadcrumbs", "token_count", "text", "embedding_text"]
    assert record["embedding_text"].startswith("Guide > 1. Installation\n\n")
    old = json.loads(c.jsonl({"id": "x", "docId": "d", "breadcrumbs": "A > B", "text": "corps"}))
    assert old == {"id": "x", "doc_id": "d", "breadcrumbs": "A > B", "text": "corps", "embedding_text": "A > B\n\ncorps"}


_block = st.one_of(st.text(alphabet="abc. Éé1", min_size=1, max_size=60), st.sampled_from(["# A", "## B", "```\nx\n```", "|a|b|\n|---|---|\n|1|2|", "- x\n- y"]))


@settings(max_examples=40, deadline=None, derandomize=True)
@given(st.lists(_block, min_size=1, max_size=15).map("\n\n".join), st.sampled_from([32, 64]))
def test_no_text_is_lost_and_chunks_stay_small(text, most):
    out = c.chunk(text, "d", "D", most=most, overlap=0)
    joined = re.sub(r"\s+", "", "".join(x["content"] for x in out))
    for line in text.split("\n"):
        bare = re.sub(r"\s+", "", line)
        if bare and not line.startswith("#"):
            assert bare in joined or count_tokens(line) > most
    assert all(x["token_count"] <= most + 5 + x["content"].count("\n\n") for x in out)  # a join may take two tokens of a stand-in vocabulary
