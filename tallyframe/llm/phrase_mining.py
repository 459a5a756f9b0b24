"""Collocations by dynamic itemset counting: phrases of several lengths are counted in the same cyclic scans.

The texts are dealt into shards that are scanned in turn, again and again.  Words are counted from the first scan on.  A longer phrase becomes active
once both its subphrases of one word less have reached the threshold, and is counted until each shard has been
scanned once since; scans end when no phrase is active.  So lengths are interleaved, and phrases that cannot
be frequent are not counted.

Which phrases are active is told to the tasks by bit fields of fixed size, whose false hits only let more be counted: counts are kept by shard,
so a shard that is counted twice counts once, and a phrase not counted in all shards has a rare subphrase.  Tasks combine their
counts before the shuffle.  Words travel as 64-bit codes of word and language; if two words ever share a code, all is done anew
with other codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import spans as S
from tallyframe.storage import settle

#: Words counted together in a task, and rows handed on together.
CHUNK_WORDS = 1 << 20
BATCH_ROWS = 1 << 16
#: Texts longer than this are cut at ends of pieces.
TEXT_BYTES = 1 << 20
#: The fields that tell which phrases have reached the threshold have some 16 bits a phrase, and no more than 2^26 (8 MB).
FIELD_BITS = 26

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = True
_SEPARATORS = _BREAKS.copy()
_SEPARATORS[[0x20, 0x09]] = True
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _extended(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of a phrase and the word after it."""
    with np.errstate(over="ignore"):
        return S.mix(hashes * _STEP + words)


def _window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words; the windows may cross pieces."""
    count = max(len(codes) - size + 1, 0)
    out = S.mix(codes[:count])
    for j in range(1, size):
        out = _extended(out, codes[j : j + count])
    return out


class Field:
    """Bits of hashes, as 64-bit words."""

    def __init__(self, bits: int, words: np.ndarray):
        self.shift, self.words = np.uint64(64 - bits), words

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes >> self.shift
        return (self.words[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def field_of(phrases: DataFrame, size: int) -> Field | None:
    """The field of the phrases (w1, ... of ``size`` words); None if there are none.  At most 2^FIELD_BITS / 64 rows reach the driver."""
    held = phrases.count()
    if not held:
        return None
    width = min(FIELD_BITS, max(6, (16 * held).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = S.mix(batch.column(0).to_numpy().view(np.uint64))
            for j in range(1, size):
                hashes = _extended(hashes, batch.column(j).to_numpy().view(np.uint64))
            slots = hashes >> np.uint64(64 - width)
            bit = np.uint64(1) << (slots & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], names=["word", "bits"])

    parts = phrases.select(*_words(size)).mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(max(1 << width >> 6, 1), dtype=np.uint64)
    words[parts["word"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return Field(width, words)


def _words(size: int, first: int = 1) -> list[str]:
    return [f"w{j}" for j in range(first, first + size)]


def _pieces(text: bytes) -> list[bytes]:
    """A long text cut at ends of pieces, where it has any."""
    out = []
    while len(text) > TEXT_BYTES:
        cut = max(text.rfind(b, 0, TEXT_BYTES) for b in (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r"))
        if cut < 0:
            break
        out.append(text[: cut + 1])
        text = text[cut + 1 :]
    return [*out, text]


class _Coded:
    """Words of many texts as codes; ``joined``: the word before is of the same piece."""

    def __init__(self, seed: int, spell: bool):
        self.seed, self.spell, self.langs = np.uint8(seed), spell, {}
        self.clear()

    def clear(self) -> None:
        self.codes, self.joined, self.spelled, self.lang_of, self.count = [], [], [], [], 0

    def add(self, langs: list[str], texts: list[bytes]) -> None:
        for start, end in S.chunks(texts):
            spans = S.word_spans(texts[start:end], _SEPARATORS, lower=True)
            if not len(spans.starts):
                continue
            for lang in langs[start:end]:
                if lang not in self.langs:
                    digest = hashlib.blake2b(lang.encode(), digest_size=8, salt=bytes([self.seed])).digest()
                    self.langs[lang] = len(self.langs), int.from_bytes(digest, "big")
            # Another seed deals the byte values of the hash anew.
            hashes = S.span_hash(spans.buffer ^ self.seed, spans.starts, spans.ends)
            own = np.array([self.langs[lang] for lang in langs[start:end]], dtype=np.uint64).reshape(-1, 2)[spans.owner]
            ends = np.concatenate([[0], np.cumsum(_BREAKS[spans.buffer])])
            self.codes.append(S.mix(hashes ^ own[:, 1]))
            self.joined.append(np.concatenate([[False], ends[spans.starts[1:]] == ends[spans.ends[:-1]]]))
            if self.spell:
                self.spelled.append((spans.buffer.tobytes(), spans.starts, spans.ends))
                self.lang_of.append(own[:, 0].astype(np.int64))
            self.count += len(spans.starts)


def _counted(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(some place, count) of every dense id."""
    counts = np.bincount(ids)
    place = np.empty(len(counts), dtype=np.int64)
    place[ids] = at
    return place, counts


def _batches(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for start in range(0, whole.num_rows, BATCH_ROWS):
        yield whole.slice(start, BATCH_ROWS)


def _chunks(batches: Iterator[pa.RecordBatch], coded: _Coded) -> Iterator[_Coded]:
    for batch in batches:
        langs, texts = [], []
        for lang, text in zip(batch.column(0).to_pylist(), S.texts_of(batch.column(1))):
            parts = _pieces(text)
            langs += [lang] * len(parts)
            texts += parts
        coded.add(langs, texts)
        if coded.count >= CHUNK_WORDS:
            yield coded
            coded.clear()
    if coded.count:
        yield coded


def _word_scan(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for coded in _chunks(batches, _Coded(seed, spell=True)):
            codes = np.concatenate(coded.codes)
            ids, unique = pd.factorize(codes)
            place, counts = _counted(ids, np.arange(len(codes)))
            bounds = np.concatenate([[0], np.cumsum([len(s) for _, s, _ in coded.spelled])])
            names, lang_of = list(coded.langs), np.concatenate(coded.lang_of)[place]
            chunk = np.searchsorted(bounds, place, side="right") - 1
            words = [None] * len(place)
            for i, (c, p) in enumerate(zip(chunk.tolist(), (place - bounds[chunk]).tolist())):
                buffer, starts, ends = coded.spelled[c]
                words[i] = buffer[starts[p] : ends[p]].decode()
            columns = [pa.array(unique.view(np.int64)), pa.array([names[k] for k in lang_of]), pa.array(words, pa.string()), pa.array(counts)]
            yield from _batches(columns, ["w1", "lang", "word", "n"])

    return run


def _phrase_scan(seed: int, most: int, fields):
    """Counts of the active phrases of up to ``most`` words: ``fields[size]`` are the reached and late subphrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for coded in _chunks(batches, _Coded(seed, spell=False)):
            codes, joined = np.concatenate(coded.codes), np.concatenate(coded.joined)
            whole, ids = np.ones(len(codes), dtype=bool), pd.factorize(codes)[0]
            for size in range(2, most + 1):
                whole = whole[: len(codes) - size + 1] & joined[size - 1 :]
                if size in fields.value and len(whole):
                    yield from _count_size(codes, ids, np.flatnonzero(whole), size, most, *fields.value[size])

    return run


def _count_size(
    codes: np.ndarray, ids: np.ndarray, at: np.ndarray, size: int, most: int, reached: Field, late: Field
) -> Iterator[pa.RecordBatch]:
    """Counts of the active ones of the phrases that start ``at``; ``ids`` are dense numbers of the codes."""
    hashes = _window_hashes(codes, size - 1)
    frequent = reached.may_hold(hashes)
    at = at[frequent[at] & frequent[at + 1]]
    recent = late.may_hold(hashes)
    at = at[recent[at] | recent[at + 1]]
    if not len(at):
        return
    phrase, words = ids[at], ids.max() + 1
    for j in range(1, size):
        phrase = pd.factorize(phrase * words + ids[at + j])[0]
    place, counts = _counted(phrase, at)
    columns = [codes[place + j].view(np.int64) for j in range(size)] + [np.zeros(len(place), dtype=np.int64)] * (most - size)
    yield from _batches([pa.array(np.full(len(place), size, dtype=np.int32)), *map(pa.array, columns), pa.array(counts)], ["size", *_words(most), "n"])


def _total(shards: int) -> Column:
    return reduce(lambda a, b: a + b, (F.col(f"c{s}") for s in range(shards)))


def _unfinished(most: int, fields):
    """Drops phrases below the threshold that no further scan will count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, stays = batch.column("size").to_numpy(), ~np.isnan(batch.column("reach").to_numpy(zero_copy_only=False).astype(float))
            codes = [batch.column(w).to_numpy().view(np.uint64) for w in _words(most)]
            for size, (reached, late) in fields.value.items():
                some = np.flatnonzero(sizes == size)
                first, rest = S.mix(codes[0][some]), S.mix(codes[1][some])
                for j in range(1, size - 1):
                    first, rest = _extended(first, codes[j][some]), _extended(rest, codes[j + 1][some])
                open_ = reached.may_hold(first) & reached.may_hold(rest) & (late.may_hold(first) | late.may_hold(rest))
                stays[some] |= open_
            yield batch.filter(pa.array(stays))

    return run


def _merged(state: DataFrame | None, counts: DataFrame, shard: int, shards: int, most: int, step: int, threshold: int) -> DataFrame:
    """Counts by shard and the step at which they reached the threshold, or else (``born``) were first counted; a shard counted again has the same counts."""
    keys = ["size", *_words(most)]
    # One column in the exchange for both steps; the larger one is right, as what has been reached has no sign.
    rows = counts.select(*keys, "n", *(F.lit(0).cast("bigint").alias(f"c{s}") for s in range(shards)), F.lit(-1 - step).alias("mark"))
    if state is not None:
        mark = F.coalesce("reach", -1 - F.col("born")).alias("mark")
        rows = rows.unionByName(state.select(*keys, F.lit(0).cast("bigint").alias("n"), *(f"c{s}" for s in range(shards)), mark))
    # Tasks have combined their counts, and most phrases are rare: nothing is left to combine before the exchange.
    sums = rows.repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"), *(F.max(f"c{s}").alias(f"c{s}") for s in range(shards)), F.max("mark").alias("mark"))
    held = sums.withColumn(f"c{shard}", F.greatest("n", f"c{shard}")).drop("n")
    reach = F.when(F.col("mark") >= 0, F.col("mark")).when(_total(shards) >= threshold, F.lit(step))
    return held.select(*keys, *(f"c{s}" for s in range(shards)), reach.alias("reach"), F.when(reach.isNull(), -1 - F.col("mark")).alias("born"))


def _still_open(state: DataFrame, shards: int, step: int) -> DataFrame:
    """Drops phrases below the threshold that have been counted in all shards, or were counted too early by a false hit and will be anew.

    With two shards, what was first counted at ``step`` - 1 is not active after ``step`` unless its active time only begins then.  With
    more, a phrase could be dropped in the midst of its active time, so :func:`_unfinished` alone decides.
    """
    return state.where(F.col("reach").isNotNull() | (F.col("born") > step - shards + 1)) if shards <= 2 else state


def _merged_words(state: DataFrame | None, counts: DataFrame, step: int, threshold: int) -> DataFrame:
    name = F.struct("lang", "word")
    rows = counts.select("w1", name.alias("least"), name.alias("last"), "n", F.lit(None).cast("int").alias("reach"))
    if state is not None:
        rows = state.select("w1", "least", "last", "n", "reach").unionByName(rows)
    sums = rows.groupBy("w1").agg(F.min("least").alias("least"), F.max("last").alias("last"), F.sum("n").alias("n"), F.min("reach").alias("reach"))
    return sums.withColumn("reach", F.coalesce("reach", F.when(F.col("n") >= threshold, F.lit(step))))


def count_phrases(
    docs: DataFrame, threshold: int, most: int, shards: int, seed: int = 0, lang_col: str = "lang", text_col: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Words (w1, lang, word, n), phrases (size, w1, ..., n) that occur ``threshold`` times or more, and words (lang, n) per language.

    None if two words share a code under this seed.
    """
    context = docs.sparkSession.sparkContext
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    scanned = lambda s: texts.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == s)
    schema = f"size int, {', '.join(f'{w} bigint' for w in _words(most))}, n bigint"
    words = phrases = carried = per_lang = None
    step, fields, shared = 0, {}, None
    while step < shards or fields:
        shard = step % shards
        if fields:
            counts = scanned(shard).mapInArrow(_phrase_scan(seed, most, shared), schema)
            phrases = settle(_still_open(_merged(carried, counts, shard, shards, most, step, threshold), shards, step), "phrases")
            shared.destroy()
        if step < shards:
            counts = scanned(shard).mapInArrow(_word_scan(seed), "w1 bigint, lang string, word string, n bigint")
            words = settle(_merged_words(words, counts, step, threshold), "words")
            if step == shards - 1:
                if not words.where("least <> last").isEmpty():
                    return None
                per_lang = settle(words.groupBy("least.lang").agg(F.sum("n").alias("n")), "languages")
                words = settle(words.where("reach IS NOT NULL").select("w1", "least", "last", "n", "reach"), "words")
        step += 1
        fields = {}
        for size in range(2, most + 1):
            if size > 2 and phrases is None:
                continue
            shorter = (words if size == 2 else phrases.where(F.col("size") == size - 1)).where("reach IS NOT NULL")
            late = field_of(shorter.where(F.col("reach") >= step - shards), size - 1)
            if late is not None:
                fields[size] = field_of(shorter, size - 1), late
        if fields:
            shared = context.broadcast(fields)
            # Until each shard has been scanned once, nothing is finished.
            carried = phrases if phrases is None or step <= shards else phrases.mapInArrow(_unfinished(most, shared), phrases.schema)
    words = words.select("w1", "least.lang", "least.word", "n")
    if phrases is None:
        phrases = docs.sparkSession.createDataFrame([], f"{schema}, reach int").drop("reach")
        return words, phrases, per_lang
    return words, phrases.select("size", *_words(most), _total(shards).alias("n")).where(F.col("n") >= threshold), per_lang


def _scored(words: DataFrame, phrases: DataFrame, most: int) -> DataFrame:
    """(size, w1.., lang, phrase, a, l, r, score) of all candidates, by the cut of the lowest score."""
    known = {1: words.select("w1", "lang", F.col("word").alias("phrase"), F.col("n").alias("a"))}
    for size in range(2, most + 1):
        rows = phrases.where(F.col("size") == size).select("size", *_words(most), F.col("n").alias("a"))
        cuts = []
        for k in range(1, size):
            first = known[k].select(*_words(k), F.col("a").alias(f"l{k}"), *([F.col("phrase").alias("head")] if k == size - 1 else []))
            rest = known[size - k].select(
                *(F.col(w).alias(x) for w, x in zip(_words(size - k), _words(size - k, k + 1))), F.col("a").alias(f"r{k}"),
                *([F.col("phrase").alias("tail"), "lang"] if k == size - 1 else []),
            )
            rows = rows.join(first, _words(k)).join(rest, _words(size - k, k + 1))
            score = F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) DIV (CAST(l{k} AS DECIMAL(16,0)) * CAST(r{k} AS DECIMAL(16,0)))")
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        low = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        done = rows.select("size", *_words(most), "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "a", low.alias("low"))
        known[size] = settle(done.select("size", *_words(most), "lang", "phrase", "a", "low.l", "low.r", "low.score"), "candidates")
    return reduce(DataFrame.unionByName, (known[k] for k in range(2, most + 1)))


def _undropped(candidates: DataFrame, most: int, percent: int) -> DataFrame:
    """Candidates without those of which a longer one that holds them has ``percent`` of the occurrences or more."""
    if most < 3:
        return candidates
    inside = []
    for size in range(3, most + 1):
        for part in range(2, size):
            for first in range(1, size - part + 2):
                names = [F.col(x).alias(w) for w, x in zip(_words(part), _words(part, first))]
                blank = [F.lit(0).cast("bigint").alias(w) for w in _words(most - part, part + 1)]
                inside.append(F.struct(F.lit(part).alias("size"), *names, *blank, F.when(F.col("size") == size, F.col("a")).alias("longer")))
    held = candidates.where("size > 2").select(F.explode(F.array(*inside)).alias("p")).select("p.*").where("longer IS NOT NULL")
    most_held = held.groupBy("size", *_words(most)).agg(F.max("longer").alias("longer"))
    return candidates.join(most_held, ["size", *_words(most)], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * percent, F.lit(True)))


def _ranked(rows: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their rank, by a sort of the whole table: no group meets in one task."""
    part = settle(
        rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumns({
            "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
        }),
        "ranked",
    )
    starts = part.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = F.sum("_rows").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = settle(starts.select(group, "_part", (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift")), "starts")
    placed = part.join(starts, [group, "_part"]).withColumn("rank", F.col("_at") + F.col("_shift") + 1)
    return placed.where(F.col("rank") <= limit).drop("_part", "_at", "_shift")


def mine_phrases(
    docs: DataFrame, threshold: int = 10, most: int = 3, percent: int = 50, limit: int = 2000, shards: int = 2, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``limit`` best phrases of 2 to ``most`` words that occur ``threshold`` times or more.

    A-Z are lower-cased, pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are runs without blank or tab, and a phrase lies in one piece;
    overlapping occurrences count.  ``a``, ``l`` and ``r`` are the occurrences of the phrase, of its first part and of its rest at the cut of the lowest score
    floor(1000000 a a / (l r)) (ties: the earliest cut), ``n`` all words of the language.  Phrases inside a longer one that
    has ``percent`` of their occurrences are left out; ties are ranked by a, then by bytes.  A null text is empty, a
    null language is ``und``.  Long texts are read in parts that end where a piece does.  Repeated rows count as often as
    they are there, an empty table or one without frequent phrases has an empty result, and other columns are ignored.
    """
    seed, counted = 0, None
    while counted is None:
        counted = count_phrases(docs, threshold, most, shards, seed, lang_col, text_col)
        seed += 1
    words, phrases, per_lang = counted
    candidates = _undropped(_scored(words, settle(phrases, "frequent"), most), most, percent)
    best = _ranked(candidates.select("lang", "phrase", "a", "l", "r", "score"), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], limit)
    return best.join(per_lang, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
