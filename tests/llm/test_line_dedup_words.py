import random
import re

from pyspark.sql import functions as F

from tallyframe.llm.line_dedup import _sliding_min, _word_parity, _words, _words_differ, _words_within, dedup_lines
from tests.llm.test_line_dedup import distance, expected_ids


def some_line(pick, n):
    return " ".join("".join(pick.choice("abcdefghé") for _ in range(pick.randint(2, 9))) for _ in range(n))


def changed(pick, line, edits):
    words = line.split(" ")
    for k in range(edits):
        at = len(words) * (2 * k + 1) // (2 * edits)  # evenly: the longest run that stays is as short as can be
        words[at : at + pick.choice([0, 1, 1])] = pick.choice([["unlike"], ["different"], ["and", "other"][:1]])
    return " ".join(words)


def test_lines_link_by_one_word_in_twenty(spark):
    pick = random.Random(5)
    docs, dropped = [], {}
    for k, n in enumerate([20, 21, 39, 40, 59, 60, 78, 79, 80, 81, 82, 83, 99, 100, 119, 120, 200, 400, 2400]):
        line = some_line(pick, n)
        near = changed(pick, line, n // 20)
        far = changed(pick, line, n // 20 + 6)
        docs += [(10 * k, line), (10 * k + 1, near), (10 * k + 2, far)]
        dropped |= {10 * k: [], 10 * k + 1: [0], 10 * k + 2: []}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.dropped for r in dedup_lines(frame).collect()} == dropped


def test_word_distance_and_groups(spark):
    pick = random.Random(6)
    pairs = []
    for _ in range(150):
        a = some_line(pick, pick.choice([18, 20, 40, 61]))
        words = a.split(" ")
        for _ in range(pick.choice([0, 1, 2, 3, 4])):
            at = pick.randrange(len(words))
            words[at : at + pick.choice([0, 1])] = pick.choice([[], ["new"], [words[0]]])
        pairs.append((a, " ".join(words)))
    a, b = F.col("a"), F.col("b")
    frame = spark.createDataFrame(pairs, "a string, b string")
    for r in frame.select("a", "b", _words_within(_words(a), _words(b)).alias("near"), _words_differ(*((_word_parity(_words(a), k), _word_parity(_words(b), k)) for k in (0, 1))).alias("parity")).collect():
        x, y = r.a.split(" "), r.b.split(" ")
        true, most = distance(x, y), min(len(x), len(y)) // 20
        assert r.near == (most > 0 and true <= most)
        assert r.parity <= 2 * true


def test_no_python_in_the_plan_of_long_lines(spark):
    frame = spark.createDataFrame([(1, some_line(random.Random(1), 90))], "doc_id long, text string")
    assert not re.search("Python|Arrow|Pandas", dedup_lines(frame)._jdf.queryExecution().executedPlan().toString())


def test_least_of_neighbours(spark):
    pick = random.Random(7)
    rows = [([pick.randrange(50) for _ in range(n)],) for n in (0, 1, 5, 6, 7, 12, 40)]
    six, twelve = (_sliding_min(F.col("v"), w).alias(f"w{w}") for w in (6, 12))
    for r in spark.createDataFrame(rows, "v array<bigint>").select("v", six, twelve).collect():
        for window, got in ((6, r.w6), (12, r.w12)):
            whole = max(len(r.v) - window + 1, 0)
            assert got[:whole] == [min(r.v[i : i + window]) for i in range(whole)]


def test_group_of_near_copies_by_all_pairs(spark):
    """Near copies of one line, of which many link with each other but not with the pivot, and copies that differ by characters too."""
    pick = random.Random(8)
    docs = []
    for n in (24, 45, 90):
        line = some_line(pick, n)
        for k in range(25):
            near = changed(pick, line, pick.randint(1, 2 * (n // 20)))
            docs.append((len(docs), near if k % 3 else near.replace("a", "e", 1)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.dropped for r in dedup_lines(frame).collect()} == expected_ids(docs)
