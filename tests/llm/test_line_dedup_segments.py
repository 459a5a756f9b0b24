import random

from pyspark.sql import functions as F

from tallyframe.llm.line_dedup import (
    LEAST_WINDOWED, SEGMENTS, SHINGLE, WINDOW, _distinct_texts, _keyed, _lines, _lines_within, _place, _segment_starts, _trimmed, _words, dedup_lines,
)
from tests.llm.test_line_dedup import distance, expected_ids
from tests.llm.test_line_dedup_words import some_line


def edited(pick, line, edits):
    """At most so many words added, removed or replaced, anywhere, of those that a near copy may have."""
    words = line.split(" ")
    for _ in range(edits):
        at = pick.randrange(len(words) + 1)
        words[at : at + pick.choice([0, 1, 1])] = pick.choice([["unlike"], ["different"], []])
    return " ".join(words)


def spoiled(pick, line):
    """Two characters added, removed or replaced, blanks too, so that words are split and joined."""
    chars = list(line)
    for _ in range(2):
        at = pick.choice([pick.randrange(len(chars)), *(i for i, c in enumerate(chars) if c == " ")])
        chars[at : at + pick.choice([0, 1])] = pick.choice(["z", " ", ""])
    return "".join(chars).strip()


def test_segments_fit_and_move_as_edits_allow():
    for k, (least, edits, size) in enumerate(SEGMENTS):
        border = SEGMENTS[k + 1][0] if k + 1 < len(SEGMENTS) else LEAST_WINDOWED
        assert (edits + 1) * size + edits <= least and edits >= max(2, (border - 1) // 20)
        own, moved = _segment_starts(edits, size)
        assert len(own) == edits + 1
        for n in (least, border - 1 + edits):
            for start in own + moved:
                at = start - 1 if start > 0 else n + start
                assert 0 <= at <= n - size
    for n in range(LEAST_WINDOWED, 6 * LEAST_WINDOWED):
        most = max(n // 20, 2)
        assert -(-(n - max(n // 20, 4)) // (most + 1)) >= WINDOW + SHINGLE - 1


def test_near_copies_share_an_index_key(spark):
    pick = random.Random(11)
    rows = []
    for n in [18, 19, 20, 21, 29, 30, 39, 40, 41, 59, 60, 79, 80, 99, 100, 119, 120, 139, 140, 159, 160, 161, 200, 320] * 6:
        line = some_line(pick, n)
        for other in (edited(pick, line, n // 20), spoiled(pick, line)):
            x, y = line.split(" "), other.split()
            if other != line and (distance(line, other) <= 2 or distance(x, y) <= min(len(x), len(y)) // 20):
                rows += [(2 * len(rows), line), (2 * len(rows) + 1, other)]
    frame = spark.createDataFrame([(h, t, len(t)) for h, t in rows], "h1 long, line string, chars int")
    keys = {}
    for r in _keyed(frame).collect():
        keys.setdefault(r.h1, (set(), set()))[1].add(r.key)
        if r.own:
            keys[r.h1][0].add(r.key)
    assert len(rows) > 300
    for (a, s), (b, t) in zip(rows[::2], rows[1::2], strict=True):
        assert keys[a][0] & keys[b][1] or keys[b][0] & keys[a][1], (s, t)


def test_near_lines_by_all_pairs(spark):
    """Lines around the borders of the classes, with odd blanks, near copies by words and by characters."""
    pick = random.Random(12)
    docs = []
    for n in (19, 21, 30, 40, 60, 81, 100, 121, 140, 160):
        line = some_line(pick, n)
        near = [edited(pick, line, n // 20), spoiled(pick, line), edited(pick, line, n // 20 + 2), "\t" + line.replace(" ", "  ", 2) + " \r", line.replace(" ", "\t", 1)]
        docs += [(len(docs) + k, x) for k, x in enumerate([line, *near])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.dropped for r in dedup_lines(frame).collect()} == expected_ids(docs)


def test_words_in_common_do_not_count(spark):
    pick = random.Random(13)
    pairs = []
    for _ in range(150):
        line = some_line(pick, pick.choice([19, 20, 41, 80]))
        pairs.append((line, edited(pick, line, pick.randint(0, 5))))
    pairs += [(line + " more", line) for line, _ in pairs[:5]] + [("one more " + line, line) for line, _ in pairs[:5]] + [(line.replace(" ", "  ", 1), line) for line, _ in pairs[:5]]
    a, b = F.col("a"), F.col("b")
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", _lines_within(a, b).alias("near")).collect():
        x, y = r.a.split(), r.b.split()
        most = min(len(x), len(y)) // 20
        assert r.near == (most > 0 and distance(x, y) <= most)


def test_every_line_is_taken_at_one_place(spark):
    """Also lines that are there once and that the filter of the repeated ones does not let go by chance."""
    docs = [(i, f"line number {i % 7000} which stands here by itself or twice") for i in range(9000)]
    plain = spark.createDataFrame(docs, "id long, text string").select("id", F.col("id").alias("k1"), F.col("id").alias("k2"), "text")
    found = _lines(plain)
    lines = found.groupBy("h1", "h2").agg(F.min(_place()).alias("place"), F.count("*").alias("n"))
    taken = [r.line for r in _distinct_texts(found, lines).collect()]
    assert set(taken) == {t for _, t in docs} and len(taken) < 7100


def test_blanks_at_the_ends_and_between(spark):
    lines = ["", " ", "a", " a", "a\x0b", "\ta b\r", "a \t b", "a  b\x0cc", "é ü", "a\u00a0b "]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", _trimmed(F.col("x")).alias("t"), _words(_trimmed(F.col("x"))).alias("w")).collect()
    for r in rows:
        assert r.t == r.x.strip(" \t\r\x0b\x0c")
        assert r.w == [w for w in r.t.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w] or r.w == [""] and not r.t


def test_line_dedup_makes_few_keys(spark):
    """Cost: before, a line of 57 words had some 22 keys, now 5 in its class of words."""
    pick = random.Random(14)
    frame = spark.createDataFrame([(h, x, len(x)) for h in range(20) for x in [some_line(pick, 57)]], "h1 long, line string, chars int")
    assert _keyed(frame).count() == 20 * 5
