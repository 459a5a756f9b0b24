import hashlib
import random
import zlib

import pytest

from tallyframe.llm import prefix_trie as trie
from tallyframe.llm.prefix_trie import conversation_turns, member_digests, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, depth string, keys int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)


def brute(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    convs = dict(own)
    if rebuild:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 9
            convs[c] = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, members in nodes.items():
        under = [p for p in nodes if p[: len(prefix)] == prefix]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(prefix))
        out.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members),
            sum(len(p) == len(prefix) + 1 for p in under), len(leaves),
            sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def nodes(conversations):
    return sorted((tuple(r) for r in prefix_trie(conversations).collect()), key=str)


@pytest.mark.parametrize("group", [2, 256])
def test_nodes_are_those_of_the_definition(spark, monkeypatch, group):
    monkeypatch.setattr(trie, "GROUP_ROWS", group)
    monkeypatch.setattr(trie, "CHUNK_ROWS", 8)
    monkeypatch.setattr(trie, "SEGMENT_IDS", 3)
    pick = random.Random(group)
    rows = []
    for c in range(60):
        rows += [(c, t, pick.choice(["user", "bot"]) if t else "system", "hällo" if t < 3 else pick.choice("abé")) for t in range(pick.randint(1, 9))]
    rows += [(c, t, "user", "same " * t) for c in range(100, 125) for t in range(3)]  # copies
    rows += [(200, t, "user", "long" if t < 9 else "x") for t in range(13)] + [(201, t, "user", "long") for t in range(11)]
    table = frame(spark, rows)
    assert nodes(rebuilt(conversation_turns(table))) == brute(rows)
    assert nodes(conversation_turns(table)) == brute(rows, rebuild=False)


def test_odd_rows(spark):
    rows = [(5, None, None, "b"), (5, 0, "user", None), (6, 3, "u", "x"), (6, 3, "u", "x"), (None, 0, "user", "none"), (-7, 0, None, None),
            (10, 0, "ab", "c"), (11, 0, "a", "bc"), (12, 0, "user", "y" * 300_000)] + [(c, 0, "u", "only") for c in range(20, 60)]
    table = frame(spark, rows)
    assert nodes(rebuilt(conversation_turns(table))) == brute(rows)
    assert nodes(rebuilt(conversation_turns(table.limit(0)))) == []


def test_digests_of_groups_in_segments(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT_IDS", 4)
    pick = random.Random(1)
    rows = [(bytes([pick.randint(0, 3) ** 2]), i) for i in pick.sample(range(-50, 10**12), 300)]
    groups = {}
    for own, i in rows:
        groups.setdefault(own, []).append(i)
    want = {own: (min(v), len(v), hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()) for own, v in groups.items()}
    done = member_digests(spark.createDataFrame(rows, "own binary, conv_id long").repartition(5))
    assert {bytes(r.own): (r.conv_id, r.n, r.ends) for r in done.collect()} == want
