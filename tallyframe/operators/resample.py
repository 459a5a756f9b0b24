"""Bootstrap intervals and paired tests over runs that share their examples.

An example matters to a resample only through its *profile*: the true class and
the prediction of every run.  Rows are therefore grouped by profile once, and a
replicate is a vector of profile counts.  ``code`` is the profile as an integer
array ``[truth, run 1, run 2, ...]``, repeated per task when tasks share draws.

Two ways to draw the counts, with the same law:

``cells``
    Multinomial counts over the profiles.  The cost per replicate is the number
    of distinct profiles, which with many runs comes near the number of rows.  Profiles are
    dealt into blocks; a replicate divides its draws over the blocks by halves and then inside
    each block, so no task ever holds all profiles.
``hash``
    One keyed hash per draw, reproducible in any SQL engine.  The cost is
    replicates times rows: a draw is hashed on arrays and shuffled as two bytes, its place in
    a block of positions.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import hash60, stars
from tallyframe.functions.keyed_numbers import hash60_of_numbers
from tallyframe.operators.metrics import per_class
from tallyframe.storage import settle

NO_PREDICTION = -1
NO_RUN = -2
ALL_TASKS = "*"
MEAN_TASK = "Mean macro-F1"

_PROFILES_PER_BLOCK = 4096
_BLOCKS_PER_BUNDLE = 32
_CELLS_BY_PRODUCT = 64
_REPLICATES_PER_CHUNK = 25
_DRAWS_PER_CHUNK = 4096
_DRAWS_PER_TASK = 2_000_000
_DRAWS_PER_PACKED_CHUNK = 1 << 20
_DRAWS_PER_PACKED_TASK = 1 << 24
_POSITIONS_PER_BLOCK = 1 << 16  # so that a place in a block has two bytes
_REPLICATES_PER_GROUP = 250
_BROADCAST_BYTES = 10 << 20

_DRAWN = "slot int, b int, member int, y_true int, y_pred int, n bigint"


def align_runs(
    predictions: DataFrame, tasks: Sequence[str], runs: Sequence[str], joint: bool = False
) -> DataFrame:
    """One row per example with its profile: ``(scope, row_idx, code)``.

    ``scope`` is the task, or ``*`` when ``joint`` puts all tasks of an example
    into one profile.  A run twice for an example, or disagreeing truths, fail
    the job; examples without any truth are left out, as they are not judged.
    """
    chosen = predictions.where(F.col("task").isin(list(tasks)) & F.col("run").isin(list(runs)))
    answer = F.coalesce(F.col("y_pred").cast("int"), F.lit(NO_PREDICTION))
    votes = [F.max(F.when(F.col("run") == r, answer)).alias(f"p{i}") for i, r in enumerate(runs)]
    rows = chosen.groupBy("task", "row_idx").agg(
        F.min("y_true").alias("lowest"),
        F.max("y_true").alias("highest"),
        F.count("y_true").alias("rows"),
        *votes,
    ).where("rows > 0")
    present = sum((F.col(f"p{i}").isNotNull().cast("int") for i in range(len(runs))), F.lit(0))
    sound = (F.col("lowest") == F.col("highest")) & (F.col("rows") == present)
    truth = F.when(sound, F.col("lowest").cast("int")).otherwise(
        F.raise_error(
            F.concat(
                F.lit("runs cannot be paired at task "), "task",
                F.lit(", row "), F.col("row_idx").cast("string"),
            )
        ).cast("int")
    )
    code = F.array(
        truth, *(F.coalesce(F.col(f"p{i}"), F.lit(NO_RUN)) for i in range(len(runs)))
    )
    rows = rows.select("task", "row_idx", code.alias("code"))
    if not joint:
        return rows.select(F.col("task").alias("scope"), "row_idx", "code")
    per_task = [
        F.max(F.when(F.col("task") == t, F.col("code"))).alias(f"t{i}")
        for i, t in enumerate(tasks)
    ]
    whole = F.concat(*(F.col(f"t{i}") for i in range(len(tasks))))
    checked = F.when(whole.isNotNull(), whole).otherwise(
        F.raise_error(
            F.concat(F.lit("row lacks a task: "), F.col("row_idx").cast("string"))
        ).cast("array<int>")
    )
    return (
        rows.groupBy("row_idx")
        .agg(*per_task)
        .select(F.lit(ALL_TASKS).alias("scope"), "row_idx", checked.alias("code"))
    )


def profile_counts(
    predictions: DataFrame, tasks: Sequence[str], runs: Sequence[str], joint: bool = False
) -> DataFrame:
    """Examples per profile: ``(scope, code, n)``, settled and checked.

    A run must answer all examples of a task or none, as pairing by example needs.
    """
    aligned = align_runs(predictions, tasks, runs, joint)
    profiles = settle(
        aligned.groupBy("scope", "code").agg(F.count("*").alias("n")), "profiles"
    )
    gaps = F.transform(F.col("code"), lambda p: (p == NO_RUN).cast("int"))
    partial = (
        profiles.groupBy("scope")
        .agg(F.min(gaps).alias("low"), F.max(gaps).alias("high"))
        .where("low <> high")
        .select("scope")
        .collect()
    )
    if partial:
        raise ValueError(f"a run lacks some examples of {sorted(r['scope'] for r in partial)}")
    return profiles


def bootstrap_draws(
    sizes: DataFrame, replicates: int, seed: int = 0, joint: bool = False, packed: bool = False
) -> DataFrame:
    """Positions drawn with replacement: one row per (scope, b, k) with ``at`` in ``[0, total)``.

    ``sizes`` has a row per scope with its ``total``; its other columns are kept.
    Draws depend on seed, scope, replicate and ``k`` alone - on seed, replicate
    and ``k`` when ``joint``, so that all scopes share them.

    ``packed`` gives the same draws as rows (scope, b, block, places): those of some thousand ``k`` that fall into a
    block of 65,536 positions, as two bytes each, the place in the block.
    """
    per_chunk = _DRAWS_PER_PACKED_CHUNK if packed else _DRAWS_PER_CHUNK
    per_task = _DRAWS_PER_PACKED_TASK if packed else _DRAWS_PER_TASK
    chunks = sizes.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b")
    ).select(
        "*",
        F.explode(F.expr(f"sequence(0L, (total - 1) div {per_chunk})")).alias("chunk"),
    )
    first = F.col("chunk") * per_chunk
    upto = F.least(first + per_chunk, F.col("total"))
    # A count of its own, so that adaptive execution does not merge the few small
    # chunk rows into one task: each of them unfolds into thousands of draws.
    total = int(sizes.agg(F.sum("total")).first()[0] or 0)
    parts = max(
        sizes.sparkSession.sparkContext.defaultParallelism, total * replicates // per_task
    )
    scope: list[Column] = [] if joint else [F.col("scope")]
    chunks = chunks.repartition(parts, "scope", "b", "chunk")
    if packed:
        key = F.concat_ws("|", F.lit(str(seed)), *scope, F.col("b").cast("string"))
        return _packed_draws(
            chunks.select(*sizes.columns, "b", key.alias("_key"), first.alias("_first"), upto.alias("_upto")), sizes.columns
        )
    text = [F.col(c).cast("string") for c in ("b", "k")]
    at = F.coalesce(hash60(str(seed), *scope, *text) % F.col("total"), F.lit(0))
    return (
        chunks.select(*sizes.columns, "b", F.explode(F.sequence(first, upto - 1)).alias("k"))
        .select("*", at.alias("at"))
    )


def _packed_draws(chunks: DataFrame, kept: Sequence[str]) -> DataFrame:
    """The draws ``_first`` up to ``_upto`` of each row under ``_key``, by block of positions."""
    names = [*kept, "b"]

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            work = zip(*(batch.column(c).to_pylist() for c in ("_key", "_first", "_upto", "total")))
            for row, (key, first, upto, total) in enumerate(work):
                if upto <= first:
                    continue
                size = np.uint64(total)
                at = np.concatenate([h - h // size * size for h in hash60_of_numbers(key, first, upto)])
                block = (at // np.uint64(_POSITIONS_PER_BLOCK)).astype("int64")
                place = (at % np.uint64(_POSITIONS_PER_BLOCK)).astype("<u2")
                if total > _POSITIONS_PER_BLOCK:
                    narrow = block.astype("uint16") if total <= _POSITIONS_PER_BLOCK << 16 else block
                    by_block = np.argsort(narrow, kind="stable")
                    block, place = block[by_block], place[by_block]
                starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
                ends = np.append(starts, len(block)).astype("<i4") * 2
                places = pa.BinaryArray.from_buffers(
                    pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(place))]
                )
                same = pa.array(np.full(len(starts), row))
                columns = [batch.column(c).take(same) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(block[starts]), places], [*names, "block", "places"])

    schema = T.StructType(
        [*(chunks.schema[c] for c in names), T.StructField("block", T.LongType()), T.StructField("places", T.BinaryType())]
    )
    return chunks.mapInArrow(draw, schema)


def _scope_number(tasks: Sequence[str], joint: bool) -> Column:
    """Small integer standing for the scope: fixed-width keys are cheaper to group by."""
    if joint:
        return F.lit(0)
    return (F.array_position(F.array(*map(F.lit, tasks)), F.col("scope")) - 1).cast("int")


def _hash_cells(
    profiles: DataFrame,
    tasks: Sequence[str],
    runs: Sequence[str],
    replicates: int,
    seed: int,
    joint: bool,
) -> DataFrame:
    """Keyed draws, as confusion counts.

    Profiles own consecutive positions, in the order of hashed blocks and of code
    inside a block, so that no window holds the profiles of more than one block.
    A draw is a position.  The draws in 65,536 consecutive positions, of some replicates, meet the
    profiles that own these and are counted there; only counts of cells go on.
    """
    dealt = profiles.withColumn("block", _code_block(F.col("code")))
    scope = Window.partitionBy("scope")
    upto = F.sum("n").over(scope.orderBy("block"))
    blocks = settle(
        dealt.groupBy("scope", "block")
        .agg(F.sum("n").alias("n"), F.count("*").alias("held"))
        .select(
            "scope",
            _scope_number(tasks, joint).alias("slot"),
            "block",
            "held",
            (upto - F.col("n")).alias("before"),
            F.sum("n").over(scope).alias("total"),
        ),
        "blocks",
    )
    # There are at most 4096 blocks a scope; beside few profiles even these are not worth a broadcast.
    profiles_held = int(blocks.agg(F.sum("held")).first()[0] or 0)
    row_bytes = 8 * (len(runs) + 1) * (len(tasks) if joint else 1)
    small = profiles_held * row_bytes <= _BROADCAST_BYTES
    within = F.sum("n").over(Window.partitionBy("scope", "block").orderBy("code"))
    placed = (
        dealt.select("scope", "block", "code", "n", within.alias("hi"))
        .join(blocks.select("scope", "slot", "block", "before").hint("broadcast" if small else "merge"), ["scope", "block"])
        .select("slot", "code", (F.col("before") + F.col("hi") - F.col("n")).alias("lo"), (F.col("before") + F.col("hi")).alias("hi"))
    )
    wide = _POSITIONS_PER_BLOCK
    start, end = F.greatest("lo", F.col("block") * wide), F.least("hi", (F.col("block") + 1) * wide)
    pieces = (
        placed.select("*", F.explode(F.expr(f"sequence(lo div {wide}, (hi - 1) div {wide})")).alias("block"))
        .select(
            "slot", "block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // _REPLICATES_PER_GROUP))).alias("part"),
            "code", start.alias("start"), (end - start).alias("held"),
        )
    )
    sizes = blocks.groupBy("scope", "slot").agg(F.max("total").alias("total"))
    draws = bootstrap_draws(sizes, replicates, seed, joint, packed=True).select(
        F.col("slot").alias("of_slot"), F.col("block").alias("of_block"),
        F.expr(f"b div {_REPLICATES_PER_GROUP}").cast("int").alias("of_part"), "b", "places",
    )
    members, starts = len(runs), range(0, (len(runs) + 1) * len(tasks), len(runs) + 1)

    def count(key, drawn, owners):
        import numpy as np

        parts = []
        if drawn.num_rows and owners.num_rows:
            owners = owners.sort_by("start")
            flat = np.concatenate([c.flatten() for c in owners.column("code").chunks])
            code = flat.reshape(owners.num_rows, -1).astype("int64")
            owner = np.repeat(np.arange(len(code)), np.asarray(owners.column("held")))
            slots = list(enumerate(starts)) if joint else [(key[0].as_py(), 0)]
            found = {}
            for b, places in zip(drawn.column("b").to_pylist(), drawn.column("places")):
                found.setdefault(b, []).append(np.frombuffer(places.as_buffer(), dtype="<u2"))
            numbers = np.array(sorted(found))
            for first in range(0, len(numbers), _REPLICATES_PER_CHUNK):
                some = numbers[first : first + _REPLICATES_PER_CHUNK]
                times = np.stack([sum(np.bincount(owner[p], minlength=len(code)) for p in found[b]) for b in some.tolist()])
                parts += _reduced(code, times, some, slots, members)
        return _drawn_table(parts)

    cells = (
        draws.groupBy("of_slot", "of_block", "of_part")
        .cogroup(pieces.groupBy("slot", "block", "part"))
        .applyInArrow(count, _DRAWN)
    )
    return cells.groupBy("slot", "b", "member", "y_true", "y_pred").agg(F.sum("n").alias("n"))


def _reduced(code, drawn, numbers, places, members):
    """The draws of profiles as counts of (slot, replicate, run, truth, answer)."""
    import numpy as np

    parts, exact = [], drawn.astype("float64")
    for slot, start in places:
        truth = code[:, start]
        for member in range(members):
            answer = code[:, start + 1 + member]
            if answer[0] == NO_RUN:
                continue
            base = int(answer.max()) + 2
            pair = truth * base + answer + 1
            distinct = np.arange(int(pair.min()), int(pair.max()) + 1)
            if len(distinct) <= _CELLS_BY_PRODUCT:
                # Counts are far under 2^53, so the product of doubles is exact.
                member_of = np.zeros((len(pair), len(distinct)))
                member_of[np.arange(len(pair)), pair - distinct[0]] = 1.0
                sums = (exact @ member_of).astype("int64")
            else:
                by_pair = np.argsort(pair, kind="stable")
                distinct, starts = np.unique(pair[by_pair], return_index=True)
                sums = np.add.reduceat(drawn[:, by_pair], starts, axis=1)
            at, cell = np.nonzero(sums)
            rows = (
                np.full(len(at), slot), numbers[at], np.full(len(at), member),
                distinct[cell] // base, distinct[cell] % base - 1, sums[at, cell],
            )
            parts.append(np.stack(rows))
    return parts


def _drawn_table(parts):
    """Counts as a table of ``_DRAWN``."""
    import numpy as np
    import pyarrow as pa

    slot, b, member, y_true, y_pred, n = np.concatenate(parts or [np.empty((6, 0), int)], axis=1)
    return pa.table(
        {
            "slot": pa.array(slot, pa.int32()),
            "b": pa.array(b, pa.int32()),
            "member": pa.array(member, pa.int32()),
            "y_true": pa.array(y_true, pa.int32()),
            "y_pred": pa.array(y_pred, pa.int32(), mask=y_pred < 0),
            "n": pa.array(n, pa.int64()),
        }
    )


def _code_block(code: Column) -> Column:
    """Three hex digits that deal the profiles into 4096 blocks."""
    return F.substring(F.md5(F.array_join(code.cast("array<string>"), ",")), 1, 3)


def _block_paths(dealt: DataFrame) -> DataFrame:
    """(of_scope, of_block, path): per level of the binary tree of blocks, the rows left and in all below the node above.

    Each block knows the sums along its own way from the root only, one pair per level.
    """
    sums = dealt.groupBy("scope", "levels", "block").agg(F.sum("n").alias("m"))
    nodes = (
        sums.select("scope", "levels", "block", "m", F.explode(F.expr("sequence(0, levels)")).alias("level"))
        .groupBy("scope", "level", F.expr("shiftright(block, levels - level)").alias("node"))
        .agg(F.sum("m").alias("sum"))
    )
    steps = sums.select(
        "scope", "block", F.explode_outer(F.expr("if(levels > 0, sequence(1, levels), null)")).alias("level"), "levels"
    ).select("scope", "block", "level", F.expr("shiftright(block, levels - level)").alias("at"))
    above = nodes.select("scope", (F.col("level") + 1).alias("level"), F.col("node").alias("upper"), F.col("sum").alias("whole"))
    left = nodes.where("node % 2 = 0").select("scope", "level", F.shiftright("node", 1).alias("upper"), F.col("sum").alias("left"))
    found = (
        steps.withColumn("upper", F.shiftright("at", 1))
        .join(above, ["scope", "level", "upper"], "left")
        .join(left, ["scope", "level", "upper"], "left")
    )
    step = F.struct("level", "at", F.coalesce("left", F.lit(0)).cast("bigint").alias("left"), F.col("whole").cast("bigint").alias("whole"))
    path = F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), step))).alias("path")
    return found.groupBy(F.col("scope").alias("of_scope"), F.col("block").alias("of_block")).agg(path)


def _multinomial_cells(
    profiles: DataFrame,
    tasks: Sequence[str],
    runs: Sequence[str],
    replicates: int,
    seed: int,
    joint: bool,
    per_block: int,
) -> DataFrame:
    """Multinomial draws, reduced to confusion counts inside each block.

    A replicate's draws are divided over the blocks by halves of a binary tree: the draw at a node
    is keyed by seed, scope and node, so every block below it finds the same numbers, and a
    block needs one draw per level instead of one per other block.  Nothing depends on other scopes.
    """
    sizes = {
        r["scope"]: (r["t"], r["m"])
        for r in profiles.groupBy("scope").agg(F.count("*").alias("t"), F.sum("n").alias("m")).collect()
    }
    totals = {s: m for s, (_, m) in sizes.items()}
    levels = {s: (max(1, -(-t // per_block)) - 1).bit_length() for s, (t, _) in sizes.items()}
    known = F.create_map(*(F.lit(v) for pair in levels.items() for v in pair)) if levels else F.create_map().cast("map<string,int>")
    dealt = profiles.withColumn("levels", known[F.col("scope")]).withColumn(
        "block", F.expr("cast(pmod(xxhash64(code), shiftleft(1L, levels)) as int)")
    )
    width, members = len(runs) + 1, len(runs)
    # Tasks of a profile, each with the place of its truth in the code.
    slots = {
        s: list(enumerate(range(0, width * len(tasks), width))) if joint else [(list(tasks).index(s), 0)]
        for s in sizes
    }

    def mark_of(scope):
        return zlib.crc32(scope.encode())

    def draw(key, table, path):
        import numpy as np
        import pyarrow as pa

        scope = key[0].as_py()
        paths = dict(zip(path.column("of_block").to_pylist(), path.column("path").to_pylist()))
        held, dealt_to = [], np.asarray(table.column("block"))
        for block in np.unique(dealt_to).tolist():
            inside = table.filter(pa.array(dealt_to == block))
            flat = np.concatenate([c.flatten() for c in inside.column("code").chunks])
            code = flat.reshape(inside.num_rows, -1).astype("int64")
            n = np.asarray(inside.column("n"), dtype="int64")
            order = np.lexsort(code.T[::-1])
            code, n = code[order], n[order]
            mine = np.full(replicates, totals[scope], dtype="int64")
            for step in paths[block]:
                level, at = step["level"], step["at"]
                toss = np.random.default_rng([seed, mark_of(scope), level, at >> 1])
                to_left = toss.binomial(mine, step["left"] / step["whole"])
                mine = mine - to_left if at % 2 else to_left
            held.append((block, code, n / n.sum(), mine))
        code = np.concatenate([c for _, c, _, _ in held])
        parts = []
        for first in range(0, replicates, _REPLICATES_PER_CHUNK):
            numbers = np.arange(first, min(first + _REPLICATES_PER_CHUNK, replicates))
            drawn = np.empty((len(numbers), len(code)), dtype="int64")
            for i, b in enumerate(numbers):
                start = 0
                for block, own, shares, mine in held:
                    inner = np.random.default_rng([seed, mark_of(scope), int(b), block, 1 << 20])
                    drawn[i, start : start + len(own)] = inner.multinomial(int(mine[b]), shares)
                    start += len(own)
            parts += _reduced(code, drawn, numbers, slots[scope], members)
        return _drawn_table(parts)

    # Adaptive merging would put many blocks into one task; each is a good deal of work.
    # Blocks of a bundle are counted together: each count of a cell that goes on stands for all of them.
    spark = profiles.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = sum(1 << v for v in levels.values())
    least = max(shuffled, spark.sparkContext.defaultParallelism)
    together = max(1, min(_BLOCKS_PER_BUNDLE, held // (2 * least)))
    tasks_wanted = max(1, min(held, max(shuffled, held // (2 * together))))
    bundle = F.expr(f"block div {together}").cast("int").alias("bundle")
    blocks = dealt.select("scope", bundle, "block", "code", "n").repartition(tasks_wanted, "scope", "bundle")
    paths = _block_paths(dealt).withColumn("of_bundle", F.expr(f"of_block div {together}").cast("int"))
    cells = (
        blocks.groupBy("scope", "bundle")
        .cogroup(paths.groupBy("of_scope", "of_bundle"))
        .applyInArrow(draw, _DRAWN)
    )
    return cells.groupBy("slot", "b", "member", "y_true", "y_pred").agg(F.sum("n").alias("n"))


def replicate_counts(
    predictions: DataFrame, tasks: Sequence[str], runs: Sequence[str], replicates: int = 1000, seed: int = 0,
    joint: bool = False, profiles_per_block: int = _PROFILES_PER_BLOCK,
) -> DataFrame:
    """Confusion counts of every run on every replicate: ``(task, b, run, y_true, y_pred, n)``."""
    profiles = profile_counts(predictions, tasks, runs, joint)
    cells = _multinomial_cells(profiles, tasks, runs, replicates, seed, joint, profiles_per_block)
    return cells.select(
        F.get(F.array(*map(F.lit, tasks)), F.col("slot")).alias("task"), "b",
        F.get(F.array(*map(F.lit, runs)), F.col("member")).alias("run"), "y_true", "y_pred", "n",
    )


def replicate_scores(
    predictions: DataFrame,
    tasks: Sequence[str],
    runs: Sequence[str],
    replicates: int = 1000,
    seed: int = 0,
    method: str = "cells",
    joint: bool = False,
    profiles_per_block: int = _PROFILES_PER_BLOCK,
) -> DataFrame:
    """Macro F1 of every run on every replicate: ``(task, b, run, macro_f1)``.

    All runs of a task see the same draw.  F1 is over the classes present in the
    replicate.
    """
    profiles = profile_counts(predictions, tasks, runs, joint)
    if method == "hash":
        cells = _hash_cells(profiles, tasks, runs, replicates, seed, joint)
    elif method == "cells":
        cells = _multinomial_cells(
            profiles, tasks, runs, replicates, seed, joint, profiles_per_block
        )
    else:
        raise ValueError(f"unknown method {method!r}")
    by = ["slot", "b", "member"]
    scores = per_class(cells, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    return scores.select(
        F.get(F.array(*map(F.lit, tasks)), F.col("slot")).alias("task"),
        "b",
        F.get(F.array(*map(F.lit, runs)), F.col("member")).alias("run"),
        "macro_f1",
    )


def bootstrap_ci(
    predictions: DataFrame,
    tasks: Sequence[str],
    runs: Sequence[str],
    replicates: int = 1000,
    alpha: float = 0.05,
    seed: int = 0,
    method: str = "cells",
) -> DataFrame:
    """Mean and percentile interval of the macro F1 averaged over runs, per task."""
    scores = replicate_scores(predictions, tasks, runs, replicates, seed, method)
    means = scores.groupBy("task", "b").agg(F.avg("macro_f1").alias("score"))
    return interval(means, "score", alpha)


def interval(replicates: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """Mean and linear-interpolation percentiles over the replicates of a task."""
    return replicates.groupBy("task").agg(
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(alpha / 2)).alias("low"),
        F.percentile(value, F.lit(1 - alpha / 2)).alias("high"),
        F.count(value).alias("replicates"),
    )


def paired_deltas(
    predictions: DataFrame,
    tasks: Sequence[str],
    candidates: Sequence[str],
    baselines: Sequence[str],
    replicates: int = 1000,
    seed: int = 0,
    method: str = "cells",
    across_tasks: bool = False,
) -> DataFrame:
    """Candidate mean minus baseline mean on each shared draw: ``(task, b, delta)``.

    Tasks without a baseline are left out (``missing_baselines`` lists them).
    With ``across_tasks`` one draw serves all tasks and a row per replicate with
    the mean over the tasks is added.
    """
    runs = [*candidates, *baselines]
    scores = replicate_scores(
        predictions, tasks, runs, replicates, seed, method, joint=across_tasks
    )

    def side(names: Sequence[str]) -> Column:
        return F.avg(F.when(F.col("run").isin(list(names)), F.col("macro_f1")))

    # The order in which floats are added is not fixed; rounding keeps equal means equal,
    # so that a difference of zero counts as zero in the p-values.
    deltas = (
        scores.groupBy("task", "b")
        .agg((F.round(side(candidates) - side(baselines), 12) + F.lit(0.0)).alias("delta"))
        .where(F.col("delta").isNotNull())
    )
    if not across_tasks:
        return deltas
    draws = deltas.groupBy("b").agg(
        F.collect_list(F.struct("task", "delta")).alias("tasks"),
        F.struct(F.lit(MEAN_TASK).alias("task"), (F.round(F.avg("delta"), 12) + F.lit(0.0)).alias("delta")).alias("mean"),
    )
    return draws.select("b", F.explode(F.array_append("tasks", F.col("mean"))).alias("d")).select(
        "d.task", "b", "d.delta"
    )


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def p_one_sided(mean: Column, share_low: Column, share_high: Column) -> Column:
    """Share of replicates on the other side of zero than the mean."""
    return F.when(mean > 0, share_low).otherwise(share_high)


def p_two_sided(share_low: Column, share_high: Column) -> Column:
    return F.least(F.lit(1.0), F.least(share_low, share_high) * 2.0)


def compare_paired(
    deltas: DataFrame, alpha: float = 0.05, margin: float = 0.02
) -> DataFrame:
    """Everything read off the paired replicates: interval, p-values, equivalence.

    ``equivalent`` is two one-sided tests at ``alpha`` against ``+-margin``; its
    interval is the ``1 - 2*alpha`` one.
    """
    d = F.col("delta")
    table = deltas.groupBy("task").agg(
        F.avg(d).alias("delta"),
        F.percentile(d, F.lit(alpha / 2)).alias("low"),
        F.percentile(d, F.lit(1 - alpha / 2)).alias("high"),
        F.percentile(d, F.lit(alpha)).alias("tost_low"),
        F.percentile(d, F.lit(1 - alpha)).alias("tost_high"),
        _share(d <= 0).alias("_low"),
        _share(d >= 0).alias("_high"),
        F.greatest(_share(d >= margin), _share(d <= -margin)).alias("tost_p"),
        F.count(d).alias("replicates"),
    )
    one = p_one_sided(F.col("delta"), F.col("_low"), F.col("_high"))
    return table.select(
        "task", "delta", "low", "high",
        one.alias("p_one_sided"),
        stars(one).alias("stars"),
        p_two_sided(F.col("_low"), F.col("_high")).alias("p_two_sided"),
        "tost_low", "tost_high", "tost_p",
        (F.col("tost_p") < alpha).alias("equivalent"),
        "replicates",
    )
