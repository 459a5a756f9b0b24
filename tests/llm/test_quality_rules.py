import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import repetition
from tallyframe.llm.repetition import COUNTS, GRAM_PERCENT, MEASURES, measure, repetition_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    length = lambda items: sum(len(w) for x in items for w in WORD.findall(x))
    result = {
        "n_words": len(words), "word_chars": length(words), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(dup), "n_lines": len(lines), "dup_line_chars": length(dup),
    }
    for n in (3, *GRAM_PERCENT):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        seen = Counter(grams)
        earlier = lambda i: n == 3 or grams[i] in grams[:i]
        covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 and earlier(i) for k in range(n)}
        if n == 3:
            result["n_repeat_words"] = len(covered)
        else:
            result[f"dup_{n}gram_chars"] = sum(len(words[i]) for i in covered)
    return result


def by_numpy(texts):
    m = measure([t.encode() for t in texts])
    return [{n: int(m[n][i]) for n in (*COUNTS, *MEASURES)} for i in range(len(texts))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b\u00a0#|", max_size=120), min_size=1, max_size=5))
def test_counts_are_those_of_the_definition(texts):
    assert by_numpy(texts) == [counted(t) for t in texts]


def test_long_text_and_neighbours():
    texts = ["x y z " * 30000, "", "the end of it\n" * 3, "a b c d e f g h i j k"]
    assert by_numpy(texts)[2:] == [counted(t) for t in texts[2:]]
    assert by_numpy(texts)[0]["n_repeat_words"] == 90000


def test_nulls_repeated_rows_and_clashing_columns(table, monkeypatch):
    monkeypatch.setattr("tallyframe.llm.spans.CHUNK_BYTES", 64)
    good = " ".join(f"word{i}" for i in range(60))
    docs = table("doc_id long, text string, kept string, n_words int", (1, good, "x", 1), (1, good, "x", 1), (None, None, None, None), (2, "", "y", 2), (3, "a b c " * 40, "z", 3))
    got = sorted(((r.doc_id or -1, r.n_words, r.base_failed, r.kept) for r in repetition_rules(docs).collect()))
    assert got == [(-1, 0, True, False), (1, 60, False, True), (1, 60, False, True), (2, 0, True, False), (3, 120, True, False)]
    assert repetition_rules(docs.where("false")).count() == 0


@pytest.mark.parametrize("rule, text", [
    ("symbols", " ".join(f"w{i} ***" for i in range(60))),
    ("lines", "\n".join(["one line of several words here"] * 2 + [f"w{i} v{i} u{i}" for i in range(2)]) + "\n"),
    ("grams", " ".join([*(f"w{i}" for i in range(40)), *(f"passage{i}" for i in range(12)) , *(f"passage{i}" for i in range(12))])),
])
def test_each_rule_rejects(rule, text):
    base_failed, kept = repetition.verdicts(measure([text.encode()]))
    assert not kept[0]
    assert rule == "lines" or not base_failed[0]


def test_registered_query_against_the_definition(spark):
    from tallyframe.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = counted(texts[r.doc_id])
        assert {n: r[n] for n in COUNTS} == {n: want[n] for n in COUNTS}
        assert r.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
