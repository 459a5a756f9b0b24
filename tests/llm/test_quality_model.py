import zlib

import numpy as np
import pytest

from tallyframe.llm.quality_model import fit_network, fit_quality, pooled, score_quality, word_vectors, ROWS, DIMS
from tallyframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    rows = QUERIES["op3_quality_score"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert np.mean([(r.score - r.quality) ** 2 for r in held]) < 0.05


def test_nulls_empty_long_and_repeated_rows(spark):
    docs = spark.createDataFrame(
        [(1, "good clean text of words", "x"), (1, "good clean text of words", "x"), (2, "bad ### *** text", "y"), (None, None, None), (3, "", "z"), (4, "long words " * 40000, "z")],
        "doc_id long, text string, quality string",
    )
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    rows = score_quality(docs, model, ["doc_id", "quality"]).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert {r.score for r in rows if r.doc_id in (None, 3)} == {r.score for r in rows if r.doc_id == 3}
    assert score_quality(docs.where("false"), model, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        score_quality(docs, model, ["doc_id"], score_col="doc_id")
    nothing = fit_quality(docs.where("false"), labels.where("false"))
    assert {r.score for r in score_quality(docs, nothing, ["doc_id"]).collect()} == {0.5}


def test_vectors_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert (word_vectors(docs.repartition(1)) == word_vectors(docs.repartition(7))).all()


def test_words_in_like_places_have_like_vectors(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat sat on a mat", "the dog sat on a mat", "one two three four"] * 5)], "doc_id long, text string")
    vectors = word_vectors(docs)
    cat, dog, two = (pooled([w], vectors)[0, :DIMS] for w in (b"cat", b"dog", b"two"))
    assert vectors.shape == (ROWS, DIMS) and cat @ dog > 0.99 > abs(cat @ two)


def test_network_is_calibrated_on_noisy_labels():
    pick = np.random.default_rng(1)
    x = pick.normal(size=(4000, 6))
    y = (pick.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    model = fit_network(None, x[:2000], y[:2000], np.arange(2000) % 5 == 0)
    p = model.scores(x[2000:])
    for lo in np.arange(0, 1, 0.2):
        inside = (p >= lo) & (p < lo + 0.2)
        assert abs(p[inside].mean() - y[2000:][inside].mean()) < 0.09
