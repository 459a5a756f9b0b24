"""Benchmark passages in documents: a prefix-filtered set join of item windows with document shingles.

An item's windows (ten consecutive words; a shorter item is one window) are sets of
three-word shingles.  All of them must occur for the window to occur, so one necessary
shingle per window is enough to find it: the rarest in the corpus.  Documents
probe with the shingles that pass a fixed-size filter of those prefixes, the hits are joined
with the windows by shingle, position and length bounds cut what would not fit, and the words of
the whole window are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import spans as S
from tallyframe.storage import settle

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
#: Bits of the filter of shingle hashes that goes to every task (2 MB), whatever the size of the benchmark.
FILTER_BITS = 24
_FLUSH = 1 << 20


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _shingles(spans: S.Spans, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start words, hashes) of the shingles of a length within one text; the length is part of the hash."""
    at = S.windows_inside(spans, length)
    return at, S.mix(S.gram_hash(hashes, length)[at] + np.uint64(length))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window, words, shingles): the windows of all items; ``window`` is the words with single blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for item, text in zip(ids, S.texts_of(batch.column(1))):
                spans = S.word_spans([text], S.NOT_ALNUM, lower=True)
                count = len(spans.starts)
                size = min(WINDOW_WORDS, count)
                if not size:
                    continue
                words = [spans.buffer[a:b].tobytes() for a, b in zip(spans.starts, spans.ends)]
                step = min(SHINGLE_WORDS, size)
                hashes = _signed(_shingles(spans, step, S.span_hash(spans.buffer, spans.starts, spans.ends))[1])
                for k in range(count - size + 1):
                    out.append((item, b" ".join(words[k : k + size]).decode(), size, hashes[k : k + size - step + 1].tolist()))
            columns = list(zip(*out)) or [[], [], [], []]
            types = pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["item", "window", "words", "shingles"]
            )

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "item string, window string, words int, shingles array<bigint>")


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """Bit field of the column ``shingle``; at most one byte per eight slots reaches the driver."""
    slot = F.shiftrightunsigned("shingle", 64 - FILTER_BITS)
    parts = hashes.groupBy(F.floor(slot / 8).alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int"))).alias("bits")
    ).toArrow()
    field = np.zeros(1 << FILTER_BITS >> 3, dtype=np.uint8)
    field[parts["byte"].to_numpy()] = parts["bits"].to_numpy()
    return np.unpackbits(field, bitorder="little").astype(bool)


def _passing(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(field).bit_length() - 1
    return field[(hashes >> np.uint64(64 - bits)).astype(np.int64)]


def _count_shingles(texts: DataFrame, wanted: DataFrame, lengths: list[int]) -> DataFrame:
    """(shingle, n): how often the wanted shingles (and few others) occur in all texts."""
    packed = np.packbits(_filter_of(wanted)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
        held, size = [], 0

        def out() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(_signed(value)), pa.array(n)], names=["shingle", "n"])

        for batch in batches:
            found = S.texts_of(batch.column(0))
            for lo, hi in S.chunks(found):
                spans = S.word_spans(found[lo:hi], S.NOT_ALNUM, lower=True)
                words = S.span_hash(spans.buffer, spans.starts, spans.ends)
                for length in lengths:
                    hashes = _shingles(spans, length, words)[1]
                    held.append(hashes[_passing(field, hashes)])
                    size += len(held[-1])
                if size > _FLUSH:
                    yield out()
                    size = 0
        if held:
            yield out()

    return texts.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def prefixed_windows(texts: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(window, words, prefix, offset): the necessary shingle of every distinct window, and where it stands in it."""
    distinct = windows.select("window", "words", "shingles").dropDuplicates(["window"])
    placed = distinct.select("window", "words", F.posexplode("shingles").alias("offset", "shingle"))
    counts = _count_shingles(texts, placed.select("shingle"), lengths)
    first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("first")
    rarest = placed.join(counts, "shingle", "left").groupBy("window", "words").agg(first)
    return rarest.select("window", "words", F.col("first.shingle").alias("prefix"), F.col("first.offset").alias("offset"))


def _probe(docs: DataFrame, prefixes: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, id, n_words, found): every document with the places and surroundings of its possible prefixes."""
    packed = np.packbits(_filter_of(prefixes)).tobytes()
    item = pa.struct([("pos", pa.int32()), ("prefix", pa.int64()), ("back", pa.int32()), ("around", pa.string())])
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("n_words", T.LongType()),
         T.StructField("found", T.ArrayType(T.StructType([
             T.StructField("pos", T.IntegerType()), T.StructField("prefix", T.LongType()),
             T.StructField("back", T.IntegerType()), T.StructField("around", T.StringType())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
        for batch in batches:
            texts = S.texts_of(batch.column(2))
            for lo, hi in S.chunks(texts):
                spans = S.word_spans(texts[lo:hi], S.NOT_ALNUM, lower=True)
                words, owner = S.span_hash(spans.buffer, spans.starts, spans.ends), spans.owner
                found: list[list[tuple]] = [[] for _ in range(lo, hi)]
                for length in lengths:
                    at, hashes = _shingles(spans, length, words)
                    hit = np.flatnonzero(_passing(field, hashes))
                    for word, value in zip(at[hit].tolist(), _signed(hashes[hit]).tolist()):
                        doc = owner[word]
                        first = max(int(spans.bounds[doc]), word - WINDOW_WORDS + length)
                        last = min(int(spans.bounds[doc + 1]), word + WINDOW_WORDS)
                        around = b" ".join(spans.buffer[spans.starts[k] : spans.ends[k]].tobytes() for k in range(first, last))
                        found[doc].append((word - int(spans.bounds[doc]), value, word - first, around.decode("utf-8", "replace")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(spans.bounds)),
                     pa.array([[dict(zip(("pos", "prefix", "back", "around"), f)) for f in each] for each in found], pa.list_(item))],
                    names=schema.names,
                )

    return docs.select("row", "id", "text").mapInArrow(run, schema)


def _covered(spans):
    """Words inside a sorted array of (start, stop)."""
    step = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("reached"))
    return F.aggregate(
        spans, step,
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["reached"]), F.lit(0))).alias("total"),
            F.greatest(acc["reached"], s["stop"]).alias("reached"),
        ),
        lambda acc: acc["total"],
    )


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id, n_words, n_hit, hits, items) of every document row, over whole texts.

    Words are runs of letters and digits (every non-ASCII character is one of them), A-Z lower-cased.  ``hits`` are the spans of
    words (start, stop) in any occurrence of a window, ``n_hit`` the words in them, ``items`` the sorted ids (as text)
    of the items that own the windows.  A null or empty text has no words and no hits, also when ids repeat or are
    null; items without id, text or words are left out; equal windows of several items count for all of them.  Other
    columns are not looked at.  A passage in very many documents is a hot key only of the join with the windows,
    which adaptive execution can split; what is gathered per document is bounded by its length.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    windows = settle(item_windows(items, item_col, item_text_col), "item-windows")
    lengths = sorted(r[0] for r in windows.select(F.least("words", F.lit(SHINGLE_WORDS))).distinct().collect())
    prefixed = settle(prefixed_windows(rows.select("text"), windows, lengths), "window-prefixes")
    probed = settle(_probe(rows, prefixed.select(F.col("prefix").alias("shingle")), lengths), "probed")
    start = F.col("pos") - F.col("offset")
    hits = (
        probed.where(F.size("found") > 0)
        .select("row", "n_words", F.explode("found").alias("f"))
        .select("row", "n_words", "f.*")
        .join(prefixed, "prefix")
        .where((start >= 0) & (start + F.col("words") <= F.col("n_words")) & (F.col("back") >= F.col("offset")))
        .where(F.array_join(F.slice(F.split("around", " "), F.col("back") - F.col("offset") + 1, F.col("words")), " ") == F.col("window"))
        .select("row", start.alias("start"), (start + F.col("words")).alias("stop"), "window")
    )
    hits = settle(hits, "window-hits")
    places = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("hits"))
    owners = (
        hits.select("row", "window").distinct().join(windows.select("window", "item").distinct(), "window")
        .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    none = F.array().cast("array<string>")
    return (
        probed.select("row", "id", "n_words").join(places, "row", "left").join(owners, "row", "left").select(
            F.col("id").alias(id_col), "n_words",
            F.coalesce(_covered(F.col("hits")), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("hits", F.array().cast("array<struct<start:int,stop:int>>")).alias("hits"),
            F.coalesce("items", none).alias("items"),
        )
    )
