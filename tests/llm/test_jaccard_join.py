import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import jaccard_rtree as J
from tallyframe.llm.components import components


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    if len(w) < words:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))


def classes(docs, words, percent):
    sets = [shingles(t, words) for _, t in docs]
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[find(i)] = find(j)
    members = {}
    for i in range(len(docs)):
        members.setdefault(find(i), []).append(i)
    low = {k: min((docs[i][0] for i in v if docs[i][0] is not None), default=None) for k, v in members.items()}
    return sorted((str(docs[i][0]), len(sets[i]), str(low[find(i)] if sets[i] else docs[i][0])) for i in range(len(docs)))


def near_copies(seed, groups=4, copies=14):
    pick = random.Random(seed)
    word = lambda: f"w{pick.randint(0, 400)}"
    docs = []
    for g in range(groups):
        text = [word() for _ in range(pick.choice([8, 30, 60, 150]))]
        for _ in range(copies):  # a walk: neighbours are near, ends may be far apart
            text = list(text)
            for _ in range(pick.choice([0, 1, 1, 2])):
                text[pick.randrange(len(text))] = word()
            docs.append(" ".join(text))
        docs.append(" ".join(text[: len(text) // 2]))
    common = " ".join(word() for _ in range(25))
    docs += [common + " " + " ".join(word() for _ in range(k)) for k in (5, 10, 20, 20, 3)]
    docs += [common.upper(), "", None, "one", "one", "two words", "TWO\twords", "x y z"]
    pick.shuffle(docs)
    return [(i if i % 11 else i // 2, t) for i, t in enumerate(docs, 1)] + [(None, "alone here and null"), (3, docs[5]), (None, "")]


@pytest.mark.parametrize("words, percent, tile", [(3, 90, 4096), (5, 80, 3)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, words, percent, tile):
    monkeypatch.setattr(J, "TILE", tile)
    docs = near_copies(words)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, key string").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.jaccard_components(frame, words, percent).collect())
    assert got == classes(docs, words, percent)


def test_empty_table_and_no_links(spark):
    frame = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "doc_id long, text string")
    assert J.jaccard_components(frame.where("false")).count() == 0
    assert sorted((r.doc_id, r.component_id) for r in J.jaccard_components(frame).collect()) == [(1, 1), (2, 2)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 40), st.sampled_from([50, 80, 90]), st.integers(0, 10**9))
def test_linked_sets_share_a_block(common, extra_a, extra_b, percent, seed):
    pick = np.random.default_rng(seed)
    both = pick.integers(0, 1 << 63, common + extra_a + extra_b, dtype=np.uint64)
    a, b = np.unique(both[: common + extra_a]), np.unique(np.concatenate([both[:common], both[common + extra_a :]]))
    if 100 * common >= percent * (common + extra_a + extra_b) and extra_a + extra_b:
        assert np.intersect1d(J.block_keys(a, percent), J.block_keys(b, percent)).size


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 500), st.integers(0, 300), st.integers(0, 10**9))
def test_the_tree_loses_no_pair_within_the_bound(left, right, seed):
    pick = np.random.default_rng(seed)
    centres = pick.integers(0, 12, (5, J.GROUPS))
    points = np.maximum(centres[pick.integers(0, 5, left + right)] + pick.integers(-1, 2, (left + right, J.GROUPS)), 0)
    sizes, labels = points.sum(axis=1), pick.integers(0, 50, left + right)
    sides = np.repeat([0, 1], [left, right])
    nodes = np.arange(left + right)
    got = {p for a, b in J.block_pairs(nodes, labels, sizes, points, sides, 90) for p in zip(a.tolist(), b.tolist())}
    overlap = np.minimum(points[:, None], points[None]).sum(axis=2)
    ok = (overlap >= J.needed(sizes[:, None] + sizes[None], 90)) & (labels[:, None] != labels[None])
    ok &= (sides[:, None] != sides[None]) if right else (nodes[:, None] < nodes[None])
    assert got == {(min(p), max(p)) for p in zip(*(x.tolist() for x in np.nonzero(ok)))}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.vertex: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == len({got[100 + k] for k in range(40)}) == len({got[200], got[201]}) == 1
    assert len(set(got.values())) == 3 and 300 not in got


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_at_the_limit_of_a_link_share_a_block(percent):
    """Pairs at the very limit of a link, of sparse and of large sets, meet in a block."""
    rng = np.random.default_rng(percent)
    for size in [*range(2, 130), 200, 333, 500, 777, 1200, 3000]:
        for _ in range(8):
            left = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            # Some are taken away and some added, as many in all as a link allows.
            away = int(rng.integers(0, size * (100 - percent) // 100 + 1))
            most = (len(left) - away) * 100 // percent - len(left)
            added = rng.integers(0, 2**63, int(rng.integers(0, most + 1)) if rng.random() < 0.5 else most).astype(np.uint64)
            right = np.unique(np.concatenate([rng.permutation(left)[away:], added]))
            both = len(np.intersect1d(left, right))
            if 100 * both >= percent * (len(left) + len(right) - both) and not np.array_equal(left, right):
                assert len(np.intersect1d(J.block_keys(left, percent), J.block_keys(right, percent)))


def test_sets_of_ordinary_sizes_stay_out_of_the_common_blocks():
    """Chance leaves some segments empty; that must not put large sets, whose pairs all meet there, into one block."""
    rng, inside = np.random.default_rng(5), 0
    for size in range(40, 2000, 7):
        one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        common = [J.S.mix(np.array([c], dtype=np.uint64) ^ np.uint64(0x1234567))[0] for c in J._segment_counts(size, 80)]
        inside += bool(np.isin(common, J.block_keys(one, 80)).any())
    assert inside <= 2


def test_enough_segments_serve_all_sizes():
    assert all(max(d for d in range(c) if J._enough(d) <= c) <= J._served(c) for c in range(4, 1500))
