import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import phrase_mining
from tallyframe.llm.phrase_mining import mine_phrases

SCHEMA = "doc_id long, text string, lang string, n int, score string, word string, size int"


def brute(rows, threshold, most, limit):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda c: c[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, most + 1):
                counts.update((lang, tuple(words[k : k + size])) for k in range(len(words) - size + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= threshold:
            cuts = [(1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, counts[lang, p[:k]], counts[lang, p[k:]], score)
    out = []
    for lang in total:
        kept = []
        for (own, p), (a, left, rest, score) in found.items():
            longer = [q for o, q in found if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if own == lang and not any(100 * found[lang, q][0] >= 50 * a for q in longer):
                kept.append((-score, -a, " ".join(p).encode(), left, rest))
        out += [(lang, i + 1, p.decode(), -a, left, rest, total[lang], -s) for i, (s, a, p, left, rest) in enumerate(sorted(kept)[:limit])]
    return sorted(out)


def found(spark, rows, **args):
    df = spark.createDataFrame([(i, t, lang, 1, "x", "y", 9) for i, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in mine_phrases(df, **args).collect())


def corpus(seed, size):
    pick = random.Random(seed)
    words = ["a", "b", "The", "the", "é", "x-y", "日本", "0", "cc"] + [f"w{i}" for i in range(25)]
    weights = [9, 7, 6, 6, 5, 4, 4, 3, 3] + [1] * 25
    rows = []
    for _ in range(size):
        text = "".join(w + pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! "]) for w in pick.choices(words, weights, k=pick.randint(0, 40)))
        rows.append((text, pick.choice(["en", "en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize("shards,most,bits", [(2, 3, 26), (3, 4, 4), (1, 2, 8)])
def test_phrases_are_those_of_the_definition(spark, monkeypatch, shards, most, bits):
    """Also with fields so full that most phrases pass them, and in small chunks."""
    monkeypatch.setattr(phrase_mining, "FIELD_BITS", bits)
    monkeypatch.setattr(phrase_mining, "CHUNK_WORDS", 300)
    monkeypatch.setattr(phrase_mining, "TEXT_BYTES", 60)
    rows = corpus(shards, 150)
    assert found(spark, rows, threshold=4, most=most, limit=30, shards=shards) == brute(rows, 4, most, 30)


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" \t ", "en"), ("a a a a a a a a a a a a", None), ("p q. " * 12, "de"), ("p q", "de"), ("z" * 400_000 + " y", "en")]
    rows += [("One more time, one more time", "fr")] * 6 + [("no lang. " * 30_000 + "of it", "")]
    assert found(spark, rows) == brute(rows, 10, 3, 2000)
    assert found(spark, []) == [] == found(spark, [("a b c", "en")])


def test_clash_of_codes_is_found_and_coded_anew(spark, monkeypatch):
    real = phrase_mining.S.span_hash
    seeds = []

    def clashing(buffer, starts, ends):
        done = real(buffer, starts, ends)
        # Under seed 0 the words "a" and "b" share a hash.
        same = (ends - starts == 1) & np.isin(buffer[starts], [97, 98])
        return np.where(same, np.uint64(5), done)

    codes = phrase_mining._Coded(0, spell=True)
    monkeypatch.setattr(phrase_mining.S, "span_hash", clashing)
    codes.add(["en"], [b"a b c"])
    assert len(set(codes.codes[0].tolist())) == 2
    other = phrase_mining._Coded(1, spell=True)
    other.add(["en"], [b"a b c"])
    assert len(set(other.codes[0].tolist())) == 3
    monkeypatch.setattr(phrase_mining, "count_phrases", lambda *a: seeds.append(a[4]) or (None if a[4] < 2 else ("w", "p", "l")))
    with pytest.raises(AttributeError):
        mine_phrases(None)
    assert seeds == [0, 1, 2]


def test_counts_are_not_combined_again_before_the_exchange(table):
    counts = table("size int, w1 long, w2 long, w3 long, n long", (2, 1, 2, 0, 6), (2, 1, 2, 0, 5), (2, 1, 3, 0, 1))
    state = phrase_mining._merged(None, counts, 0, 2, 3, 1, 10)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") < plan.index("Exchange hashpartitioning")
    again = phrase_mining._merged(state, counts.where("n = 1"), 1, 2, 3, 2, 10)
    assert sorted((r.w2, r.c0, r.c1, r.reach) for r in again.collect()) == [(2, 11, 0, 1), (3, 1, 1, None)]


def test_rare_phrases_go_once_all_shards_are_scanned(table):
    counts = table("size int, w1 long, w2 long, w3 long, n long", (2, 1, 2, 0, 11), (2, 1, 3, 0, 1), (2, 1, 4, 0, 9))
    state = phrase_mining._still_open(phrase_mining._merged(None, counts, 1, 2, 3, 1, 10), 2, 1)
    assert state.count() == 3
    more = table("size int, w1 long, w2 long, w3 long, n long", (2, 1, 4, 0, 1), (2, 1, 5, 0, 2), (2, 1, 3, 0, 3))
    again = phrase_mining._still_open(phrase_mining._merged(state, more, 0, 2, 3, 2, 10), 2, 2)
    assert sorted((r.w2, r.c0, r.c1, r.reach, r.born) for r in again.collect()) == [(2, 0, 11, 1, None), (4, 1, 9, 2, None), (5, 2, 0, None, 2)]
    of_three = phrase_mining._merged(None, counts, 1, 3, 3, 1, 10)
    assert phrase_mining._still_open(phrase_mining._merged(of_three, more, 2, 3, 3, 2, 10), 3, 2).count() == 4
