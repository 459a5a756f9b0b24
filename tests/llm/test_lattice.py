import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import lattice_lm
from tallyframe.llm.lang_id import fit_languages, predict_language
from tallyframe.llm.lattice import Vocabulary, WordCache, expected_counts, word_scores
from tallyframe.llm.lattice_lm import fit_lattice, score_texts
from tallyframe.llm.queries import QUERIES, piece_vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tiny():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b" ab", b"aab"] + [bytes([i]) for i in range(128, 256)]
    return Vocabulary(pieces, np.linspace(0, -3, len(pieces)))


def segmentations(word, pieces):
    if not word:
        yield ()
    for p in pieces:
        if word.startswith(p):
            for rest in segmentations(word[len(p) :], pieces):
                yield (p, *rest)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=6), min_size=1, max_size=6))
def test_forward_sums_all_segmentations(words):
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b" ab", b"aab"] + [bytes([i]) for i in range(128, 256)]
    v = Vocabulary(pieces, np.linspace(0, -3, len(pieces)))
    p = dict(zip(pieces, np.exp(v.prior)))
    given_words = [w.encode() for w in words]
    ways = [list(segmentations(b" " + w, pieces)) for w in given_words]
    total = [sum(math.prod(p[x] for x in s) for s in way) for way in ways]
    assert np.allclose(word_scores(given_words, v, v.prior)[:, 0], np.log(total))
    used = Counter()
    for way, t in zip(ways, total):
        for s in way:
            for x in s:
                used[x] += 2 * math.prod(p[y] for y in s) / t
    got = expected_counts(given_words, np.full(len(words), 2.0), v, v.prior)
    assert np.allclose(got, [used[x] for x in pieces])


def test_long_words_and_cache(tiny):
    words = [b"ab" * 3000, b"a", b"b" * 70]
    direct = word_scores(words, tiny, np.stack([tiny.prior, tiny.prior - 1], axis=1))
    assert np.isfinite(direct).all()
    cache = WordCache(tiny, np.stack([tiny.prior, tiny.prior - 1], axis=1), limit=1)
    for _ in range(3):
        assert np.allclose(cache.scores(words + words), np.vstack([direct, direct]))


def lm_rows(table, *texts):
    return table("doc_id long, text string, n_tokens string", *((i, t, "x") for i, t in texts))


@pytest.mark.parametrize("frequent", [0, 3, 200_000])
def test_base_score_however_many_words_are_broadcast(table, monkeypatch, frequent):
    monkeypatch.setattr(lattice_lm, "FREQUENT_WORDS", frequent)
    train = ["The cat the DOG", "", None, "the É é cat"]
    scored = ["the cat É new word", None, "", "dog " * 500, "the cat É new word", "z" * 500]
    model = fit_lattice(lm_rows(table, *enumerate(train)), piece_vocabulary())
    tokens = lambda t: [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [""]
    counts = Counter(w for t in train for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in score_texts(lm_rows(table, *enumerate(scored)), model).collect()}
    assert len(got) == len(scored)
    for i, t in enumerate(scored):
        want = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t))
        assert got[i].base_score == pytest.approx(want)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total)
        assert -1e6 < got[i].score < 0
    assert got[0].score == got[4].score and got[1].score == got[2].score > got[0].score


def test_empty_tables(table):
    rows = lm_rows(table, (1, "a b"), (None, "c"), (1, "a b"))
    model = fit_lattice(rows.where("false"), piece_vocabulary())
    assert sorted((r.doc_id or 0, r.n_known, r.train_tokens) for r in score_texts(rows, model).collect()) == [(0, 0, 0), (1, 0, 0), (1, 0, 0)]
    assert score_texts(rows.where("false"), model).count() == 0


def test_piece_probabilities_leave_room_for_nothing_else(table):
    model = fit_lattice(lm_rows(table, (1, "one two three")), piece_vocabulary())
    assert math.isclose(np.exp(model.log_weights).sum() + math.exp(model.log_end), 1.0)


def test_score_prefers_text_like_the_training_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_lattice(docs.where("doc_id % 2 = 0"), piece_vocabulary())
    text = docs.where("doc_id = 1").first().text[:400]
    junk = "".join(reversed(text))
    rows = {r.doc_id: r.score for r in score_texts(spark.createDataFrame([(1, text), (2, junk)], "doc_id long, text string"), model).collect()}
    assert rows[1] > rows[2]


def test_languages_of_held_out_rows(spark):
    rows = QUERIES["op10_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(table):
    docs = table(
        "doc_id long, text string, lang string, lang_pred int, score int",
        (1, "the and of the and", "en", 1, 1), (2, "der die das und", "de", 1, 1), (3, None, "en", 1, 1), (4, "zzz", None, 1, 1), (None, "THE and", "en", 1, 1),
    )
    model = fit_languages(docs, piece_vocabulary())
    assert model.languages == ["de", "en"]
    asked = table("doc_id long, text string", (1, None), (2, ""), (3, "12 34 !!"), (4, "the of and"), (4, "the of and"), (5, "die das " * 20000), (None, "und der"))
    got = sorted((r.doc_id or 0, r.lang_pred) for r in predict_language(asked, model).collect())
    assert got == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    empty = fit_languages(docs.where("false"), piece_vocabulary())
    assert {r.lang_pred for r in predict_language(asked, empty).collect()} == {"und"}
    assert predict_language(asked.where("false"), model).count() == 0
