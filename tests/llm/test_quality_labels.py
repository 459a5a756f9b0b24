import pytest

import corpus_pipeline
from tallyframe.llm import quality_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("labels", [[], [(99, 1, 0)], [(1, None, 0)]])
def test_without_a_label_all_documents_stay(spark, tmp_path, labels):
    docs = spark.createDataFrame([(1, "some words of a document", "en", "s", 24), (2, None, "en", "s", None)], DOCS)
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(corpus_pipeline.good_documents(spark, docs, str(tmp_path)).collect()) == sorted(docs.collect())


def test_the_bound_holds_for_rows(spark, monkeypatch):
    """A labelled id on most rows, with copies and with texts of its own, brings no more rows than the bound."""
    rows = [(1, f"text number {k % 5} of one id") for k in range(60)] + [(k, f"text of {k}") for k in range(2, 6)] + [(1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 6)], "doc_id long, quality int")
    seen = []
    fit = quality_model.fit_network
    monkeypatch.setattr(quality_model, "fit_network", lambda v, features, *a: seen.append(len(features)) or fit(v, features, *a))
    for bound in (3, 100):
        quality_model.fit_quality(docs, labels, train_rows=bound)
    assert seen == [3, 9]
