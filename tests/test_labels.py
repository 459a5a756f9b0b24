from pyspark.sql import functions as F

from tallyframe.operators.labels import (
    class_counts,
    class_weights,
    decode,
    drop_incomplete,
    encode,
    encode_wide,
    fit_encoder,
    imbalance_report,
    map_labels,
    normalise_labels,
    num_classes,
    unpivot_labels,
)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_all_kinds_of_white_space_are_stripped(table):
    raw = ["\tA", "A ", " A ", " A B ", "\x1fA", None, "　"]
    df = table("id int, t string", *enumerate(raw))
    clean = [r.t for r in normalise_labels(df, ["t"]).orderBy("id").collect()]
    assert clean == [None if x is None else x.strip() for x in raw]


def test_missing_labels_can_become_a_class(table):
    df = table("t string", (None,), (" x ",))
    kept = normalise_labels(df, ["t"], keep_missing_as="nan")
    assert sorted(r.t for r in kept.collect()) == ["nan", "x"]


def test_flags_map_to_class_names_and_the_rest_is_dropped(table):
    df = table("id int, f string", (1, "true"), (2, " FALSE "), (3, "maybe"), (4, None), (5, "True"))
    named = map_labels(df, "f", {"TRUE": "List", "FALSE": "Single"})
    assert rows(drop_incomplete(named, ["f"]), "id") == [(1, "List"), (2, "Single"), (5, "List")]


def test_encoder_is_sorted_by_code_point_and_round_trips(table):
    names = ["b", "a", "Z", "نعم", "b"]
    long = table("row_idx int, task string, label string", *((i, "t", n) for i, n in enumerate(names)))
    encoder = fit_encoder(long)
    assert [r.class_name for r in encoder.orderBy("class_id").collect()] == sorted(set(names))
    back = decode(encode(long, encoder), encoder, {"class_id": "name"})
    assert back.where(F.col("name") != F.col("label")).count() == 0
    assert num_classes(encoder).first()["num_classes"] == 4


def test_unknown_and_null_labels_get_no_id(table):
    long = table("row_idx int, task string, label string", (1, "t", "a"), (2, "t", None))
    other = table("row_idx int, task string, label string", (1, "t", "zz"), (2, "t", None), (3, "u", "a"))
    assert [r.class_id for r in encode(other, fit_encoder(long)).collect()] == [None] * 3


def test_encode_wide_keeps_row_count_and_column_order(table):
    df = table("id int, a string, b string", (1, "x", "q"), (2, "y", "q"), (3, "x", None))
    encoder = fit_encoder(unpivot_labels(df, ["id"], ["a", "b"]))
    out = encode_wide(df, encoder, ["a", "b"])
    assert out.columns == ["id", "a", "b", "a_encoded", "b_encoded"]
    assert rows(out, "id") == [(1, "x", "q", 0, 0), (2, "y", "q", 1, 0), (3, "x", None, 0, None)]


def test_imbalance_levels_and_ties(table):
    counts = {"severe": {"a": 42, "b": 2}, "moderate": {"a": 12, "b": 2, "c": 2}, "fine": {"a": 5, "b": 1}}
    data = [(t, label) for t, c in counts.items() for label, n in c.items() for _ in range(n)]
    report = {r.task: r for r in imbalance_report(table("task string, label string", *data)).collect()}
    assert {t: r.flag for t, r in report.items()} == {"severe": "SEVERE", "moderate": "MODERATE", "fine": ""}
    assert report["moderate"].min_class == "b"
    assert report["severe"].ratio == 21.0


def test_class_weights_are_balanced_and_capped(table):
    data = [("t", "a")] * 97 + [("t", "b")] * 2 + [("t", "c")] + [("t", None)] * 5
    weights = {r.label: r.weight for r in class_weights(table("task string, label string", *data)).collect()}
    assert weights["a"] == 100 / (3 * 97)
    assert weights["c"] == 10.0
    assert weights["b"] == 10.0
    assert {r.label: r.n for r in class_counts(table("task string, label string", *data)).collect()}["a"] == 97
