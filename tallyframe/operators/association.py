"""Association between label columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows counted at once, cells of one pair that are held as a table, and of all pairs before a task hands them on.
CHUNK_ROWS = 1 << 16
PAIR_CELLS = 1 << 16
HELD_CELLS = 1 << 23


class _Tables:
    """Contingency tables of all pairs of columns, by codes of the values that one task has met."""

    def __init__(self, columns: int):
        self.pairs = list(combinations_with_replacement(range(columns), 2))
        self.columns = columns
        self.clear()

    def clear(self) -> None:
        self.codes: list[dict[str, int]] = [{} for _ in range(self.columns)]
        self.tables: dict[tuple[int, int], np.ndarray] = {}

    def _coded(self, column: int, values: pa.Array) -> np.ndarray:
        """Codes of a column's values, -1 for null."""
        found = values.dictionary_encode()
        known = self.codes[column]
        place = np.array([known.setdefault(v, len(known)) for v in found.dictionary.to_pylist()] + [-1], dtype=np.int64)
        return place[found.indices.fill_null(len(place) - 1).to_numpy()]

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Count rows; pairs with too many cells for a table are handed on at once."""
        coded = [self._coded(k, rows.column(k).combine_chunks()) for k in range(self.columns)]
        for a, b in self.pairs:
            both = (coded[a] >= 0) & (coded[b] >= 0)
            height, width = len(self.codes[a]), len(self.codes[b])
            flat = coded[a][both] * width + coded[b][both]
            if height * width > PAIR_CELLS:
                at, counts = np.unique(flat, return_counts=True)
                yield self._cells(a, b, at // max(width, 1), at % max(width, 1), counts)
                continue
            counts = np.bincount(flat, minlength=height * width).reshape(height, width)
            if (a, b) in self.tables:
                old = self.tables[a, b]
                counts[: old.shape[0], : old.shape[1]] += old
            self.tables[a, b] = counts
        if sum(t.size for t in self.tables.values()) > HELD_CELLS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (a, b), table in self.tables.items():
            first, second = np.nonzero(table)
            yield self._cells(a, b, first, second, table[first, second])
        self.clear()

    def _cells(self, a: int, b: int, first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        names = [pa.array(list(self.codes[k]), pa.string()).take(pa.array(at)) for k, at in ((a, first), (b, second))]
        pair = [pa.array(np.full(len(counts), k, dtype=np.int32)) for k in (a, b)]
        return pa.RecordBatch.from_arrays([*pair, *names, pa.array(counts.astype(np.int64))], names=["at_a", "at_b", "a", "b", "n"])


def contingency(df: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """(task_a, task_b, a, b, o): rows per pair of values, for every pair of columns in the given order (a column with itself included).

    Tasks count all pairs of their rows in integer tables and hand on the tables alone, so nothing of the size of the rows is shuffled however many
    columns there are.  Pairs in which a value is null are left out; values are compared as strings.
    """
    names = list(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, rows = _Tables(len(names)), [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield from tables.add(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from tables.add(pa.Table.from_batches(held))
        yield from tables.flush()

    labels = df.select(*(F.col(t).cast("string").alias(f"c{k}") for k, t in enumerate(names)))
    counted = labels.mapInArrow(run, "at_a int, at_b int, a string, b string, n bigint")
    cells = counted.groupBy("at_a", "at_b", "a", "b").agg(F.sum("n").alias("o"))
    named = F.array(*map(F.lit, names))
    return cells.select(F.get(named, F.col("at_a")).alias("task_a"), F.get(named, F.col("at_b")).alias("task_b"), "a", "b", "o")


def cramers_v(df: DataFrame, tasks: Sequence[str], bias_corrected: bool = False) -> DataFrame:
    """Cramér's V of every ordered pair of label columns.

    Rows become contingency tables where they are (:func:`contingency`).  Cells with no rows
    add nothing to chi-square (``chi2/N = sum(O^2/(R*C)) - 1``), so no grid is built.
    """
    pair = ["task_a", "task_b"]
    cells = contingency(df, tasks)
    marginal = cells.withColumns(
        {
            "r": F.sum("o").over(Window.partitionBy(*pair, "a")),
            "c": F.sum("o").over(Window.partitionBy(*pair, "b")),
        }
    )
    observed = F.col("o").cast("double")
    # The first cell of a row or column stands for it, so classes are counted without a distinct.
    first_in = {
        "rows": F.row_number().over(Window.partitionBy(*pair, "a").orderBy("b")) == 1,
        "cols": F.row_number().over(Window.partitionBy(*pair, "b").orderBy("a")) == 1,
    }
    stats = (
        marginal.withColumns(first_in)
        .groupBy(*pair)
        .agg(
            F.sum(observed * observed / (F.col("r").cast("double") * F.col("c"))).alias("share"),
            F.sum("o").alias("n"),
            F.count_if("rows").cast("double").alias("rows"),
            F.count_if("cols").cast("double").alias("cols"),
        )
    )
    phi2 = F.greatest(F.col("share") - 1.0, F.lit(0.0))
    rows, cols = F.col("rows"), F.col("cols")
    if bias_corrected:
        spare = F.col("n") - 1.0
        phi2 = F.greatest(phi2 - F.try_divide((rows - 1) * (cols - 1), spare), F.lit(0.0))
        rows, cols = (x - F.try_divide((x - 1) * (x - 1), spare) for x in (rows, cols))
    smaller = F.least(rows, cols) - 1.0
    v = F.coalesce(F.sqrt(F.try_divide(phi2, F.when(smaller > 0, smaller))), F.lit(0.0))
    same = F.col("task_a") == F.col("task_b")
    upper = stats.select(*pair, F.when(same, 1.0).otherwise(v).alias("v"), "n")
    both = F.array(
        F.struct(F.col("task_a").alias("x"), F.col("task_b").alias("y")),
        F.struct(F.col("task_b").alias("x"), F.col("task_a").alias("y")),
    )
    mirrored = F.when(same, F.slice(both, 1, 1)).otherwise(both)
    return upper.select(F.explode(mirrored).alias("p"), "v", "n").select(
        F.col("p.x").alias("task_a"), F.col("p.y").alias("task_b"), "v", "n"
    )


def association_matrix(pairs: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """The same values as one row per task and one column per task."""
    columns = [F.max(F.when(F.col("task_b") == t, F.col("v"))).alias(t) for t in tasks]
    return pairs.groupBy(F.col("task_a").alias("task")).agg(*columns)
