"""Token-id files: ids renumbered by frequency, in byte-aligned variable-length coding with separate control bytes.

A store is a folder: ``ranks`` (id of every rank, most frequent first) and ``blocks``, one folder per shard in
ascending document order.  A block row holds whole documents: their ids and lengths, ``skip`` (tokens of
the shard before it), ``control`` with two
bits per token (bytes of its rank, less one; four tokens to a byte, lowest bits first) and ``data`` with those
bytes, least significant first.  Frequent ids have small ranks and take one byte.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import spans as S
from tallyframe.storage import fresh_path

# Tokens of a block, if its documents are shorter than that; documents are never cut.
BLOCK_TOKENS = 1 << 18
# Words and parts of words that a task remembers.
_HELD_WORDS = 500_000
# Controls of Python's wider notion of white space that the tokenizer does not split at.
_ODD_SPACES = "\x1c\x1d\x1e\x1f"

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    taken = np.arange(4) < size[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[taken].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values back: a table gives the four lengths of each control byte."""
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:count]
    at = np.cumsum(size) - size
    stream = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    out = stream[at]
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        out[longer] |= stream[at[longer] + k] << np.uint32(8 * k)
    return out


class _Ids:
    """Lists of ids by text, in one flat array."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.first = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def add(self, texts: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.index.update(zip(texts, range(len(self.index), len(self.index) + len(texts))))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts one after the other, ids per text)."""
        rows = np.fromiter(map(self.index.__getitem__, texts), dtype=np.int64, count=len(texts))
        size = self.size[rows]
        at = np.cumsum(size) - size
        return self.ids[np.arange(int(size.sum())) + np.repeat(self.first[rows] - at, size)], size


class Encoder:
    """Ids of whole texts by a tokenizer that treats white space only as a separator.

    Words are encoded once each and remembered.  If the definition lower-cases and cuts by a pattern, as byte-level
    definitions with word ends do, words of Latin letters are cut and lower-cased here first, and only their parts, which
    are far fewer, are given to the tokenizer.  What is remembered is dropped when it grows beyond a bound.
    """

    # A digit is a part of its own, so between parts without it, it shows where one ends.
    _MARK = "7"

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        pattern = _cutting_pattern(json.loads(definition))
        self.cut = regex.compile(pattern) if pattern else None
        self.mark = self._plain([self._MARK])[0]
        if len(self.mark) != 1 or self.cut is None or self.cut.findall("a7!") != ["a", "7", "!"]:
            self.cut = None
        self.cut_lines = regex.compile(f"{pattern}|\n") if self.cut is not None else None
        self.words, self.parts = _Ids(), _Ids()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, store: _Ids, texts: list[str]) -> None:
        lists = self._plain(texts)
        store.add(texts, np.array([i for x in lists for i in x]), np.array([len(x) for x in lists], dtype=np.int64))

    def _add_marked(self, store: _Ids, texts: list[str]) -> None:
        """All the texts, none of them with the mark, as one text."""
        ids = np.array(self._plain([f" {self._MARK} ".join(texts)])[0])
        marks = np.flatnonzero(ids == self.mark[0])
        size = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
        if len(size) != len(texts):
            raise ValueError("the tokenizer does not keep words apart")
        store.add(texts, np.delete(ids, marks), size)

    def _learn(self, words: list[str]) -> None:
        easy, hard = self._sorted_out(words)
        if hard:
            self._add(self.words, hard)
        if not easy:
            return
        # One search over all words; the line feeds in between are found too and show where a word ends.
        parts = self.cut_lines.findall("\n".join(easy).lower() + "\n")
        if "\n" not in self.parts.index:
            self.parts.add(["\n"], np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64))
        new = set(parts).difference(self.parts.index)
        plain = [p for p in new if self._MARK not in p]
        if plain:
            self._add_marked(self.parts, plain)
        if len(plain) < len(new):
            self._add(self.parts, list(new.difference(plain)))
        ids, size = self.parts.of(parts)
        ends = np.flatnonzero(np.fromiter(map("\n".__eq__, parts), dtype=bool, count=len(parts)))
        self.words.add(easy, ids, np.diff(np.cumsum(size)[ends], prepend=0))

    def _sorted_out(self, words: list[str]) -> tuple[list[str], list[str]]:
        """(words of Latin letters only, all others): what lower-casing here may and may not be done to."""
        if self.cut is None:
            return [], words
        joined = "\n".join(words)
        if "<|" not in joined and (joined.isascii() or max(joined) < "\u0100"):
            return words, []
        easy, hard = [], []
        for w in words:
            (easy if (w.isascii() or max(w) < "\u0100") and "<|" not in w else hard).append(w)
        return easy, hard

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with the end id; tokens per text)."""
        if len(self.words.index) > _HELD_WORDS:
            self.words = _Ids()
        if len(self.parts.index) > _HELD_WORDS:
            self.parts = _Ids()
        lists = [_split(t) for t in texts]
        words = [w for each in lists for w in each]
        new = list(set(words).difference(self.words.index))
        if new:
            self._learn(new)
        ids, size = self.words.of(words)
        owner = np.repeat(np.arange(len(texts)), [len(each) for each in lists])
        per_text = np.bincount(owner, size, minlength=len(texts)).astype(np.int64) + 1
        out = np.full(int(per_text.sum()), end, dtype=np.uint32)
        out[np.arange(len(ids)) + np.repeat(owner, size)] = ids
        return out, per_text


def _cutting_pattern(definition: dict) -> str | None:
    """The pattern of a definition that does nothing but lower-case (after NFC) and cut by it into byte-level parts."""
    plain = [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]
    normal, cutting = definition.get("normalizer") or {}, definition.get("pre_tokenizer") or {}
    steps = cutting.get("pretokenizers") or []
    if normal.get("normalizers") != plain or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return None
    split, level = steps
    if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return None
    return split["pattern"].get("Regex")


def _split(text: str) -> list[str]:
    if any(c in text for c in _ODD_SPACES):
        return [w for part in text.split(" ") for w in part.replace("\t", "\n").split("\n") if w]
    return text.split()


def _fresh(spark: SparkSession, path: str | None) -> str:
    return path or fresh_path(spark, "token-store")


def write_token_store(
    docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Encode every whole text, append ``end_id``, and write a store in ascending order of the ids; returns its path.

    ``tokenizer`` is the text of a tokenizers-library definition.  A null text is an empty one (only the end id).
    Null ids come first; equal ids stand in the order of their texts' hashes; other columns are left out.  Texts are
    put in order by one range shuffle, encoded once, and the encoded form is written, counted for the ranks and
    coded.  Every step's files are whole documents, so a lost executor repeats only its own shards.
    """
    spark = docs.sparkSession
    path = _fresh(spark, path)
    kind = docs.schema[id_col].dataType
    ordered = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(F.col("id"), F.col("tie"))
        .sortWithinPartitions("id", "tie")
        .select(F.spark_partition_id().alias("shard"), "id", "text")
    )
    encoded_schema = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("id", kind),
         T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("skip", T.LongType())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place, skip = Encoder(tokenizer), 0, 0
        for batch in batches:
            texts = S.texts_of(batch.column(2))
            for lo, hi in S.chunks(texts):
                ids, sizes = encoder.encode([t.decode("utf-8", "replace") for t in texts[lo:hi]], end_id)
                parts = [x.tobytes() for x in np.split(ids.astype("<u4"), np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.arange(place, place + hi - lo)), batch.column(1).slice(lo, hi - lo),
                     pa.array(sizes), pa.array(parts, pa.binary()), pa.array(skip + np.cumsum(sizes) - sizes)],
                    names=encoded_schema.names,
                )
                place += hi - lo
                skip += len(ids)

    staged = fresh_path(spark, "token-ids")
    ordered.mapInArrow(encode, encoded_schema).write.option("compression", "zstd").parquet(staged)
    encoded = spark.read.schema(encoded_schema).parquet(staged)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                part = np.bincount(np.frombuffer(ids, dtype="<u4"), minlength=len(total))
                part[: len(total)] += total
                total = part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(zip(*(c.to_pylist() for c in counts.select("n", "id").toArrow().columns)), key=lambda x: (-x[0], x[1]))
    id_of_rank = np.array([i for _, i in ranked], dtype=np.int64)  # one entry per id of the vocabulary at most
    rank_of_id = np.zeros(int(id_of_rank.max(initial=0)) + 1, dtype=np.uint32)
    rank_of_id[id_of_rank] = np.arange(len(id_of_rank))
    spark.createDataFrame(
        pa.table({"rank": np.arange(len(id_of_rank)), "id": id_of_rank})
    ).coalesce(1).write.parquet(f"{path}/ranks")

    block_schema = T.StructType(
        [T.StructField("shard", T.StringType()), T.StructField("place", T.LongType()), T.StructField("skip", T.LongType()), T.StructField("n", T.LongType()),
         T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())),
         T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())]
    )
    to_arrow = pa.schema([("id", _arrow_type(encoded.select("id")))]).field("id").type

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            values = np.concatenate([np.frombuffer(r[4], dtype="<u4") for r in held])
            control, data = pack(rank_of_id[values])
            out = [f"{held[0][0]:07d}"], [held[0][1]], [held[0][5]], [len(values)], [[r[2] for r in held]], [[r[3] for r in held]], [control], [data]
            types = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(to_arrow), pa.list_(pa.int64()), pa.binary(), pa.binary()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=block_schema.names)

        tokens = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                follows = held and held[-1][0] == row[0] and held[-1][1] + 1 == row[1]
                if held and (not follows or tokens + row[3] > BLOCK_TOKENS):
                    yield block()
                    tokens = 0
                held.append(row)
                tokens += row[3]
        if held:
            yield block()

    blocks = encoded.mapInArrow(code, block_schema).sortWithinPartitions("shard", "place")
    blocks.write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/blocks")
    if not len(id_of_rank):  # without documents Spark writes no block file, and so no schema
        spark.createDataFrame([], block_schema).write.mode("overwrite").parquet(f"{path}/blocks")
    return path


def _arrow_type(frame: DataFrame) -> pa.DataType:
    return frame.limit(0).toArrow().schema.field(0).type


def read_token_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document of a store; ``start`` counts the ids of all documents before it."""
    table = spark.read.parquet(f"{path}/ranks").orderBy("rank").toArrow()
    id_of_rank = table["id"].to_numpy().astype(np.uint32)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("shard", F.col("shard").cast("int"))
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField(id_col, kind),
         T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                shard, skip, count = (one.column(k)[0].as_py() for k in range(3))
                sizes = one.column(4).flatten().to_numpy()
                ids = id_of_rank[unpack(one.column(5)[0].as_py(), one.column(6)[0].as_py(), count)].astype("<u4")
                parts = [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(sizes), pa.int32()), pa.array(skip + np.cumsum(sizes) - sizes),
                     one.column(3).flatten(), pa.array(sizes), pa.array(parts, pa.binary())],
                    names=schema.names,
                )

    decoded = blocks.select("shard", "skip", "n", "ids", "sizes", "control", "data").mapInArrow(decode, schema)
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("total"))
    bases = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    # One row of two numbers per shard, and there are no more shards than shuffle partitions: small enough to broadcast.
    return decoded.join(F.broadcast(bases), "shard").select(
        id_col, (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids"
    )
