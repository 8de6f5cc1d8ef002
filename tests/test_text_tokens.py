"""White space, rounding, token counts, prices and savings."""

import json

import pytest

from inkmill.functions import tokens
from inkmill.functions.text import ascii_word, fixed, trim, utf16_cut, utf16_len, words_of


def test_white_space_is_unicode_and_the_byte_order_mark():
    assert trim("﻿  a b 　") == "a b"
    assert words_of("a b c\x1cd") == ["a", "b", "c\x1cd"]


def test_word_edges_are_ascii():
    assert ascii_word(r"\b[A-Za-z]+@x\.com\b").findall("émail@x.com") == ["mail@x.com"]


def test_lengths_are_in_utf16_units():
    assert utf16_len("a😀") == 3
    assert utf16_cut("a😀b", 2) == "a" and utf16_cut("a😀b", 3) == "a😀"


@pytest.mark.parametrize(("value", "places", "want"), [(1.005, 2, 1.0), (0.25, 1, 0.3), (2.5, 0, 3.0)])
def test_rounding_is_exact(value, places, want):
    assert fixed(value, places) == want


def test_counts_are_stable_and_empty_is_zero():
    assert tokens.count_tokens(None) == tokens.count_tokens("") == 0
    assert tokens.count_tokens("Bonjour le monde") == tokens.count_tokens("Bonjour le monde") > 0


def test_long_runs_are_linear_and_counted_in_blocks():
    one = len(tokens.encode("A" * 32))
    assert tokens.count_tokens("A" * 100_000) == one * 3125
    assert tokens.decode(tokens.encode("x" * 500 + " été 😀")) == "x" * 500 + " été 😀"


def test_analysis_of_empty_text_has_zero_costs():
    out = tokens.analyze("")
    assert out["tokens"] == 0 and set(out["estimated_costs"].values()) == {0.0}


def test_the_encoding_named_is_the_one_used():
    assert tokens.analyze("mot")["encoding"] == tokens.encoder()[0]


def test_savings_never_negative():
    grown = tokens.savings("a", "a b c d e")
    assert grown["tokens_saved"] == 0 and grown["savings_percentage"] == 0
    assert tokens.savings("one two three four", "one")["savings_percentage"] > 50


def test_pricing_is_replaced_as_a_whole_or_not_at_all(tmp_path):
    good = [{"id": "m", "label": "M", "inputPerMillion": 3}]
    assert tokens.load_pricing({"LLM_PRICING_JSON": json.dumps(good)}) == ({"provider": "custom", "id": "m", "label": "M", "inputPerMillion": 3},)
    for bad in ("[]", "x", json.dumps(good + [{"id": "n", "label": "N", "inputPerMillion": -1}])):
        assert tokens.load_pricing({"LLM_PRICING_JSON": bad}) == tokens.PRICING
    file = tmp_path / "p.json"
    file.write_text(json.dumps(good))
    assert tokens.load_pricing({"LLM_PRICING_FILE": str(file)})[0]["id"] == "m"
    assert tokens.load_pricing({"LLM_PRICING_FILE": str(tmp_path / "none")}) == tokens.PRICING
    assert tokens.costs(1_000_000)["gpt-5.6-sol"] == 4.0
