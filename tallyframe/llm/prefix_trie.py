"""Trie of conversation prefixes by truncation peeling.

Every conversation enters as the node of its last turn.  From the greatest depth down, the conversations that end at a depth join the
nodes that survive there, equal prefixes are merged, and the last turn of each node is stripped: its prefix is an entry of the next depth.  Members, children,
leaves and saved tokens are summed on the way, so nodes are discovered and aggregated in the same pass.

Prefixes are named by chained 128-bit digests, so texts stay where they are.  Equal conversations are one entry from the start.  An entry is
peeled by a task down to its anchor, the least power of two at which no more than ``GROUP_ROWS`` different conversations share the prefix;
what is above anchors (prefixes with many continuations) is peeled one depth after the other by aggregates that
combine before the shuffle.  So neither a first turn nor a conversation that a third of all share meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.storage import fresh_path, settle

#: Different conversations below a prefix that one task may peel together.
GROUP_ROWS = 256
#: Entries peeled at once (whole groups), and ids joined to a text before they are hashed.
CHUNK_ROWS = 1 << 12
CHUNK_BYTES = 1 << 25
SEGMENT_IDS = 1 << 9

_WIDTH = 16
_ROOT = bytes(_WIDTH)
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODE = (
    "depth int, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"
)


def conversation_turns(table: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table of turns; ``turns`` has the digest of role and text, and the text's bytes.

    Turns are ordered by ``turn``, null first; equal ones by digest.  A null role or text is empty.  Rows without conv_id belong to no
    conversation.  A conversation's digests (some 40 bytes a turn, not its texts) are gathered in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)), 1, _WIDTH)
    rows = table.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("dated"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
            digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"),
        ).alias("t"),
    )
    ordered = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation ``c - c % group``; h is the crc32 of c's digits mod ``most + 1``."""
    heads = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    none = F.slice("turns", 1, 0)
    return turns.join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("head_id"), "left").select(
        "conv_id",
        F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"),
    )


def _chains(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, own, keys, sizes): the names of all prefixes, shortest first, and the bytes of their last texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(1)
            flat = turns.flatten()
            digests, sizes = flat.field(0).to_pylist(), flat.field(1).to_pylist()
            bounds = np.concatenate([[0], np.cumsum(np.diff(turns.offsets.to_numpy()))]).tolist()
            keys, all_sizes, depths, owns = [], [], [], []
            for start, end in zip(bounds, bounds[1:]):
                chain = [_ROOT]
                for digest in digests[start:end]:
                    chain.append(hashlib.blake2b(chain[-1] + digest, digest_size=_WIDTH).digest())
                keys.append(b"".join(chain))
                all_sizes.append([0, *sizes[start:end]])
                depths.append(end - start)
                owns.append(chain[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(depths, pa.int32()), pa.array(owns, pa.binary()), pa.array(keys, pa.binary()), pa.array(all_sizes, pa.list_(pa.int64()))],
                names=["conv_id", "depth", "own", "keys", "sizes"],
            )

    return settle(conversations.select("conv_id", "turns").mapInArrow(run, "conv_id bigint, depth int, own binary, keys binary, sizes array<bigint>"), "chains")


def member_digests(members: DataFrame) -> DataFrame:
    """(own, conv_id, n, ends): of each group ``own`` the smallest conv_id, how many, and the SHA-256 of all, ascending and comma-joined.

    Ids are dealt by range of group and id and joined to texts there; a task that hashes a group reads those texts in
    order and holds none of them.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, out = None, [], []

        def close() -> None:
            if ids:
                out.append((own, ids[0], len(ids), ",".join(map(str, ids))))

        def take() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[], [], [], []]
            types = pa.binary(), pa.int64(), pa.int64(), pa.string()
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["own", "conv_id", "n", "text"])

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != own or len(ids) == SEGMENT_IDS:
                    close()
                    own, ids = key, []
                ids.append(conv)
            yield take()
        close()
        yield take()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, n, state, out = None, None, 0, None, []
        for batch in batches:
            for key, conv, count, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != own:
                    if own is not None:
                        out.append((own, first, n, state.hexdigest()))
                    own, first, n, state = key, conv, 0, hashlib.sha256()
                state.update((b"," if n else b"") + text.encode())
                n += count
            yield ended(out)
            out = []
        if own is not None:
            yield ended([(own, first, n, state.hexdigest())])

    def ended(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[], [], [], []]
        types = pa.binary(), pa.int64(), pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["own", "conv_id", "n", "ends"])

    ranged = members.select("own", "conv_id").repartitionByRange("own", "conv_id").sortWithinPartitions("own", "conv_id")
    texts = ranged.mapInArrow(segments, "own binary, conv_id bigint, n bigint, text string")
    met = texts.repartition("own").sortWithinPartitions("own", "conv_id")
    return met.mapInArrow(digest, "own binary, conv_id bigint, n bigint, ends string")


def _key(depth: Column | int) -> Column:
    """The name of the prefix of a depth, out of the names of all."""
    return F.substring(F.col("keys"), F.lit(1) + F.lit(_WIDTH) * depth, F.lit(_WIDTH))


def _anchored(entries: DataFrame) -> DataFrame:
    """Entries with their anchor's depth, which may be beyond their own."""
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.col("depth").cast("double"))).cast("int"))
    power = lambda i: F.call_function("shiftleft", F.lit(1), i)
    ladder = entries.where("depth > 0").select(
        "own", "keys", F.explode(F.transform(steps, power)).alias("at")
    ).select("own", "at", _key(F.col("at")).alias("key"))
    shared = settle(ladder.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("key"), "shared-prefixes")
    deepest = ladder.join(shared, "key", "left_semi").groupBy("own").agg(F.max("at").alias("shared"))
    return entries.join(deepest, "own", "left").withColumn("anchor", F.coalesce(F.col("shared") * 2, F.lit(1))).drop("shared")


_PEELED = _NODE + ", key binary, keys binary, sizes array<bigint>"


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of entries, in order of their anchors, peeled down to these; anchors carry the names above them."""
    held, rows, size = [], 0, 0
    for batch in batches:
        anchors = batch.column("anchor_key").to_pylist()
        start = 0
        for i in range(len(anchors)):
            if (rows + i - start >= CHUNK_ROWS or size >= CHUNK_BYTES) and anchors[i] != (anchors[i - 1] if i else held[-1].column("anchor_key")[-1].as_py()):
                held.append(batch.slice(start, i - start))
                yield from _peel_chunk(pa.Table.from_batches(held))
                held, rows, size, start = [], 0, 0, i
            size += len(batch.column("keys")[i].as_buffer())
        held.append(batch.slice(start))
        rows += len(anchors) - start
    if held:
        yield from _peel_chunk(pa.Table.from_batches(held))


def _peel_chunk(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    table = table.combine_chunks()
    depth, anchor, conv, n = (table[c].to_numpy().astype(np.int64) for c in ("depth", "anchor", "conv_id", "n"))
    ends = np.array(table["ends"].to_pylist(), dtype=object)
    names = table["keys"].to_pylist()
    keys = np.frombuffer(b"".join(names), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    at = np.concatenate([[0], np.cumsum(depth + 1)[:-1]])
    sizes = table["sizes"].combine_chunks().flatten().to_numpy()
    by_depth = np.argsort(-depth, kind="stable")
    zero = lambda k: np.zeros(k, dtype=np.int64)
    empty = {c: zero(0) for c in ("rep", "n", "conv", "children", "leaves", "saved", "end")}
    nodes, taken = empty, 0
    for d in range(int(depth.max()), int(anchor.min()) - 1, -1):
        until = taken + int(np.searchsorted(-depth[by_depth[taken:]], -d, side="right"))
        new = by_depth[taken:until]
        taken = until
        # What survives is stripped of its last turn and meets the conversations that end here.
        rep = np.concatenate([nodes["rep"], new])
        if not len(rep):
            nodes = empty
            continue
        here = keys[at[rep] + d]
        order = np.lexsort((here[:, 1], here[:, 0]))
        fresh = np.concatenate([[True], (np.diff(here[order], axis=0) != 0).any(axis=1)])
        first = np.flatnonzero(fresh)
        old = len(nodes["rep"])
        total = lambda c, add: np.add.reduceat(np.concatenate([nodes[c] if c else np.ones(old, np.int64), add])[order], first)  # noqa: E731,B023
        merged = {
            "rep": rep[order][first],
            "n": total("n", n[new]),
            "conv": np.minimum.reduceat(np.concatenate([nodes["conv"], conv[new]])[order], first),
            "children": total("", zero(len(new))),
            "leaves": total("leaves", zero(len(new))),
            "saved": total("saved", zero(len(new))),
            "end": np.maximum.reduceat(np.concatenate([np.full(old, -1), new])[order], first),
        }
        merged["leaves"][merged["children"] == 0] = 1
        merged["saved"] += (merged["n"] - 1) * sizes[at[merged["rep"]] + d]
        if old:
            group = np.empty(len(rep), dtype=np.int64)
            group[order] = np.cumsum(fresh) - 1
            yield _rows(nodes, d + 1, merged["conv"][group[:old]], ends)
        top = anchor[merged["rep"]] == d
        if top.any():
            anchors = {c: v[top] for c, v in merged.items()}
            above = [names[r][: _WIDTH * d] for r in anchors["rep"]]
            heads = [sizes[at[r] : at[r] + d + 1].tolist() for r in anchors["rep"]]
            own = [names[r][_WIDTH * d : _WIDTH * (d + 1)] for r in anchors["rep"]]
            yield _rows(anchors, d, None, ends, own, above, heads)
        nodes = {c: v[~top] for c, v in merged.items()}


def _rows(nodes: dict, depth: int, parents: np.ndarray | None, ends: np.ndarray, own=None, above=None, sizes=None) -> pa.RecordBatch:
    count = len(nodes["rep"])
    blank = [None] * count
    last = [ends[e] if e >= 0 else None for e in nodes["end"]]
    columns = [pa.array(np.full(count, depth, dtype=np.int32)), pa.array(nodes["conv"]), pa.array(blank, pa.int64()) if parents is None else pa.array(parents)]
    columns += [pa.array(nodes[c]) for c in ("n", "children", "leaves", "saved")] + [pa.array(last, pa.string())]
    columns += [pa.array(own or blank, pa.binary()), pa.array(above or blank, pa.binary()), pa.array(sizes or blank, pa.list_(pa.int64()))]
    names = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "key", "keys", "sizes"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turns): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` is an array of (digest, bytes); conv_id is unique (:func:`conversation_turns`).  A conversation without turns is a member of the root alone.  An
    empty table has no nodes, not even a root.  A conversation's digests, not its texts, must fit into a task.
    """
    spark = conversations.sparkSession
    chains = _chains(conversations)
    groups = member_digests(chains)
    entries = settle(_anchored(groups.join(chains.select("conv_id", "depth", "keys", "sizes"), "conv_id")), "entries")
    grouped = entries.where("anchor <= depth").withColumn("anchor_key", _key(F.col("anchor")))
    columns = ["anchor_key", "anchor", "depth", "conv_id", "n", "ends", "keys", "sizes"]
    peeled = settle(grouped.select(columns).repartition("anchor_key").sortWithinPartitions("anchor_key").mapInArrow(_peel, _PEELED), "peeled")
    anchors = peeled.where("key IS NOT NULL")
    opened = entries.where("anchor > depth").select(
        "depth", "conv_id", F.col("n").alias("n_convs"), F.lit(0).cast("bigint").alias("n_children"), F.lit(0).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"), "ends", F.col("own").alias("key"),
        F.substring("keys", F.lit(1), F.lit(_WIDTH) * F.col("depth")).alias("keys"), "sizes",
    )
    fields = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "key", "keys", "sizes"]
    starts = settle(anchors.select(*fields, F.lit(True).alias("whole")).unionByName(opened.select(*fields, F.lit(False).alias("whole"))), "starts")
    deepest = starts.agg(F.max("depth")).first()[0]
    path = fresh_path(spark, "trie")
    _finished(peeled.where("key IS NULL")).write.parquet(f"{path}/level=-1")
    below = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = starts.where(F.col("depth") == depth)
        parts = here.where(~F.col("whole")).select(*fields)
        if below is not None:
            parts = parts.unionByName(_stripped(below))
        level = settle(_merged(parts).select(*fields).unionByName(here.where("whole").select(*fields)), "level")
        if below is not None:
            _with_parents(below, level).write.parquet(f"{path}/level={depth + 1}")
        below = level
    if below is not None:
        _finished(below.withColumn("parent_conv_id", F.lit(None).cast("bigint"))).write.parquet(f"{path}/level=0")
    done = spark.read.schema(_NODE).parquet(path)
    return done.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


def _finished(nodes: DataFrame) -> DataFrame:
    return nodes.select("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")


def _parent() -> Column:
    return F.substring(F.col("keys"), F.lit(1) + F.lit(_WIDTH) * (F.col("depth") - 1), F.lit(_WIDTH))


def _stripped(nodes: DataFrame) -> DataFrame:
    """Nodes of a depth as entries of the depth above: each is one child there."""
    return nodes.select(
        (F.col("depth") - 1).alias("depth"), "conv_id", "n_convs", F.lit(1).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens",
        F.lit(None).cast("string").alias("ends"), _parent().alias("key"),
        F.substring("keys", F.lit(1), F.lit(_WIDTH) * (F.col("depth") - 1)).alias("keys"), F.slice("sizes", F.lit(1), F.col("depth")).alias("sizes"),
    )


def _merged(entries: DataFrame) -> DataFrame:
    """Entries of one depth, equal prefixes as one node; combined before the shuffle."""
    sums = entries.groupBy("key").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends").alias("ends"),
        F.first("keys").alias("keys"), F.first("sizes").alias("sizes"),
    )
    return sums.withColumns({
        "n_leaves": F.when(F.col("n_children") == 0, F.lit(1).cast("bigint")).otherwise(F.col("n_leaves")),
        "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.element_at("sizes", -1),
    })


def _with_parents(nodes: DataFrame, above: DataFrame) -> DataFrame:
    parents = above.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return _finished(nodes.join(parents, _parent() == F.col("parent_key")))
