import random
import re

from tallyframe.llm import decontaminate
from tallyframe.llm.decontaminate import find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        doc, hit, owners = words(text), set(), set()
        for item, passage in items:
            w = words(passage)
            size = min(10, len(w))
            if item is None or not size:
                continue
            for window in {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}:
                for k in range(len(doc) - size + 1):
                    if tuple(doc[k : k + size]) == window:
                        hit.update(range(k, k + size))
                        owners.add(str(item))
        out.append((i or -1, len(doc), len(hit), sorted(owners)))
    return sorted(out)


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, hits string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, window int")
    return sorted((r.doc_id or -1, r.n_words, r.n_hit, list(r.items)) for r in find_contamination(d, b).collect())


def test_hits_are_those_of_the_definition(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 6)  # most shingles pass: the exact comparison has to do it
    random.seed(3)
    some = lambda n: " ".join(random.choice(["a", "b", "Ça", "d4", "e"]) for _ in range(n))
    items = [(i, some(random.choice([1, 2, 3, 4, 9, 10, 11, 14]))) for i in range(8)] + [(20, some(40)), (3, "again a"), (None, "a"), (30, ""), (31, None), (32, "!!")]
    docs = [(i, some(random.randint(0, 60))) for i in range(25)] + [(7, None), (None, "d4 e"), (8, "..."), (9, some(2000))]
    docs += [(100 + i, f"x, y! {items[8][1].upper()} z") for i in range(3)] + [(100, "tail")]
    assert found(spark, docs, items) == brute(docs, items)


def test_near_misses_and_overlaps(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    items = [(1, passage), (2, passage), (3, "q " * 12)]
    docs = [
        (1, passage), (2, passage.replace("w9", "x").replace("w18", "y")), (3, "q " * 30), (4, "q " * 9), (5, passage[:30]),
        (6, "w15 w16 w17 w18 w19 w20 w21 w22 w23 w24"),
    ]
    got = found(spark, docs, items)
    assert got == brute(docs, items)
    assert got[1][2:] == (0, []) and got[5][2:] == (10, ["1", "2"])


def test_empty_tables(spark):
    docs, items = [(1, "a b c")], [(1, "a b c")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert find_contamination(d.where("false"), b).count() == 0
    assert [(r.n_hit, r.hits, r.items) for r in find_contamination(d, b.where("false")).collect()] == [(0, [], [])]
