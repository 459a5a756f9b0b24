from hashlib import sha256

import corpus_pipeline
from corpus_pipeline import STAGES
from tests.llm.test_decontaminate import brute
from tests.llm.test_jaccard_join import classes
from tests.llm.test_line_dedup import expected

SF = "/root/testdata/sf0.001"


def test_stages_in_order_by_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, at the size of 200 documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    outputs = []
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(STAGES) - 1 or docs.columns == columns
        outputs.append(docs.collect())
    good, lines, single, clean, coded = outputs
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert all((i in kept) == bool(q) for i, q in labels.items())
    gone = expected([(r.doc_id, r.text) for r in good])
    text = {i: t if not p else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in p) for (i, t), p in gone.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in lines} == {i: (t, len(t)) for i, t in text.items()}
    representatives = {i for i, _, c in classes([(r.doc_id, r.text) for r in lines], 5, 80) if i == c}
    assert {str(r.doc_id) for r in single} == representatives
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean} == {i if i >= 0 else None for i, _, hit, _ in brute([(r.doc_id + 1, r.text) for r in single], items) if not hit for i in [i - 1]}
    assert {r.doc_id: r.decoded_sha256 for r in coded} == {r.doc_id: sha256(r.text.encode()).hexdigest() for r in clean}


def test_repeated_and_null_rows_pass_the_stages(spark):
    text = "a sentence that says something of its own in many words so that it has shingles"
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (None, text + " and more", "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, n_chars long")
    docs = spark.createDataFrame(docs.toArrow())
    near = corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "2", "2", "None"]
    clean = corpus_pipeline.uncontaminated(spark, docs, SF)
    assert clean.count() == 6 and clean.columns == docs.columns
    assert corpus_pipeline.distinct_lines(spark, docs, SF).count() == 6
    assert corpus_pipeline.token_ids(spark, docs, SF).count() == 6
