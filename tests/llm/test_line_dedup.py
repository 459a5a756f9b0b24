import random
import re
from functools import cache

from pyspark.sql import functions as F

from tallyframe.llm.line_dedup import _letter_counts, _letters_differ, _pieces_in_common, _within, dedup_lines, edit_distance


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def linked(a, b):
    """Equal, one edit from 20 characters and two from 40, or one word in twenty of the shorter line."""
    if a == b:
        return True
    short = min(len(a), len(b))
    most = 2 if short >= 40 else 1 if short >= 20 else 0
    if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
        return True
    x, y = words(a), words(b)
    most = min(len(x), len(y)) // 20 if short >= 20 else 0
    return most > 0 and abs(len(x) - len(y)) <= most and len(set(x) ^ set(y)) <= 2 * most and distance(x, y) <= most


@cache
def words(line):
    return tuple(re.findall("[^ \t\r\x0b\x0c]+", line))


def expected(docs):
    """{(id, text): text without repeated lines}, by all pairs of lines."""
    seen = []  # (order, line, document)
    for i, t in {d: None for d in docs}:
        for pos, raw in enumerate((t or "").split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if len(line) >= 20 or len(words(line)) >= 3:
                seen.append(((i is None, i or 0, pos), line, (i, t)))
    seen.sort(key=lambda x: x[0])
    group = list(range(len(seen)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, (_, line, _) in enumerate(seen):
        for j in range(k):
            a, b = find(k), find(j)
            if a != b and linked(line, seen[j][1]):
                group[max(a, b)] = min(a, b)
    gone = {}
    for k, (order, _, doc) in enumerate(seen):
        if find(k) != k:
            gone.setdefault(doc, []).append(order[2])
    return {d: sorted(gone.get(d, [])) for d in docs}


def some_docs(seed):
    pick = random.Random(seed)
    line = lambda n: "".join(pick.choice("abcdé ") for _ in range(n)).strip().ljust(n, "x")
    base = [line(n) for n in (19, 20, 21, 39, 40, 41, 42, 60, 90, 131)]

    def edited(text):
        chars = list(text)
        for _ in range(pick.choice([0, 0, 1, 1, 2, 3])):
            at = pick.randrange(len(chars))
            chars[at : at + pick.choice([0, 1, 1])] = pick.choice(["", "z", "é"])
        return "".join(chars)

    docs = []
    for i in range(30):
        docs.append((i, "\n".join(pick.choice(["", " ", "\t"]) + edited(pick.choice(base)) for _ in range(pick.randint(0, 7)))))
    return docs


def test_lines_are_those_of_all_pairs(spark):
    for seed in (1, 2):
        docs = some_docs(seed) + [(40, None), (41, ""), (42, "short\nshort"), (None, some_docs(seed)[3][1] + "\nand one line of its own, alone"), (3, some_docs(seed)[3][1])]
        frame = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, n_lines string, key int").repartition(4)
        rows = dedup_lines(frame).collect()
        want = expected(docs)
        assert len(rows) == len(docs)
        got = sorted((str(r.doc_id), str(r.text), tuple(r.dropped)) for r in rows)
        left = lambda t, gone: t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert got == sorted((str(i), str(left(t, want[(i, t)])), tuple(want[(i, t)])) for i, t in docs)
        assert all(r.n_dropped == len(r.dropped) and r.key == 7 for r in rows)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edit_distance_and_filter(spark):
    pick = random.Random(9)
    pairs = []
    for _ in range(500):
        a = "".join(pick.choice("aeé") for _ in range(pick.choice([20, 40, 64, 65, 130, 700])))
        b = list(a)
        for _ in range(pick.choice([0, 1, 2, 3])):
            at = pick.randrange(len(b))
            b[at : at + pick.choice([0, 1])] = pick.choice(["", "a", "é"])
        pairs.append((a, "".join(b)))
    frame = spark.createDataFrame(pairs, "a string, b string").where("abs(length(a) - length(b)) <= 2")
    a, b = F.col("a"), F.col("b")
    for r in frame.select("a", "b", edit_distance(a, b, 2).alias("d"), _pieces_in_common(a, b, 2).alias("near"), _within(a, b, 1).alias("one"), _within(a, b, 2).alias("two"), _letters_differ(_letter_counts(a), _letter_counts(b)).alias("letters")).collect():
        true = distance(r.a, r.b)
        assert r.letters <= 2 * true
        assert (r.one, r.two) == (true <= 1, true <= 2)
        assert r.d == true if true <= 2 else r.d > 2
        assert r.near or true > 2


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a line that is long enough\nb")], "doc_id long, text string")
    plan = dedup_lines(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_counts_that_fill_their_bits(spark):
    """Lines with 127 to 256 of a letter: whole packed counts pass the sign of a long."""
    most = [(k, n) for k in "eaionrts" for n in (127, 128, 255, 256)]
    pairs = [((k + " ") * n + "x" * 30, (k + " ") * (n + add) + "x" * 30) for k, n in most for add in (0, 1, -1, 2)]
    a, b = F.col("a"), F.col("b")
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", _letters_differ(_letter_counts(a), _letter_counts(b)).alias("letters")).collect():
        assert r.letters == abs(len(r.a) - len(r.b)) // 2
    docs = [(i, (k + " ") * n + "end") for i, (k, n) in enumerate(most)]
    got = {r.doc_id: r.dropped for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == expected_ids(docs)


def expected_ids(docs):
    return {i: gone for (i, _), gone in expected(docs).items()}
