"""Byte-level BPE by recursive SQL: each task runs its rows through an in-process DuckDB.

The distinct pre-tokens of a batch become (word, position, token) rows.  A recursive query joins neighbouring
tokens with the merge table, finds the least rank of each word and contracts its leftmost pair of that rank, until
no word has a pair left.  Where the vocabulary shows that no contraction can make a pair of lower rank, all
separate pairs of that rank in a word are contracted in the same step, which gives the same tokens.  Decoding
takes the bytes of every id from the table of spellings and joins them in order.
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import spans as S

_HELD_WORDS = 250_000
# Steps of one recursive query; words that need more go into the next one, so that its rows stay few.
_STEPS = 24
_MEMORY = "300MB"

# Words of up to this many bytes take one contraction a step; their rows have the key 64 * word + position.
_SHORT = 62
# The follower of a word's last token.
_NONE = (1 << 32) - 1

# A row knows its token and the next one as a pair, so no join of neighbours is needed: of two contracted rows the second
# stays, whose follower is right already, and only the row before them gets a new one.
_CONTRACT_SHORT = """
WITH RECURSIVE step(key, pair, round) AS (
  SELECT key, pair, 0 FROM start
  UNION ALL
  (WITH best AS (
    SELECT s.key // 64 AS word, min(m.rank * 64 + s.key % 64) AS choice
    FROM step s JOIN merges m ON m.pair = s.pair
    GROUP BY 1)
  SELECT CASE WHEN s.key % 64 > choice % 64 THEN s.key - 1 ELSE s.key END,
         CASE s.key % 64 - choice % 64
           WHEN 1 THEN choice // 64 * 4294967296 + s.pair % 4294967296
           WHEN -1 THEN s.pair // 4294967296 * 4294967296 + choice // 64
           ELSE s.pair END,
         s.round + 1
  FROM step s JOIN best ON best.word = s.key // 64
  WHERE s.key % 64 <> choice % 64))
SELECT key // 64 AS word, pair // 4294967296 AS token
FROM step JOIN (SELECT key // 64 AS word, max(round) AS last FROM step GROUP BY 1) ON word = key // 64 AND round = last
ORDER BY key
"""

_CONTRACT_LONG = f"""
WITH RECURSIVE step(word, pos, token, round) AS (
  SELECT word, pos, token, 0 FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN taken THEN rank ELSE token END, round + 1
  FROM (
    SELECT *, coalesce(lag(taken) OVER (PARTITION BY word ORDER BY pos), false) AS gone
    FROM (
      SELECT *, least_pair AND (place - coalesce(edge, 0)) % 2 = 1 AND (free OR nth = 1) AS taken
      FROM (
        SELECT *, max(CASE WHEN NOT least_pair THEN place END) OVER w AS edge, sum(least_pair::INT) OVER w AS nth
        FROM (
          SELECT *, coalesce(rank = low, false) AS least_pair
          FROM (
            SELECT p.*, m.rank, m.free, min(m.rank) OVER (PARTITION BY p.word) AS low
            FROM (
              SELECT *, lead(token) OVER v AS follower, row_number() OVER v AS place
              FROM step WINDOW v AS (PARTITION BY word ORDER BY pos)) p
            LEFT JOIN merges m ON m.pair = p.token * 4294967296 + p.follower)
          WHERE low IS NOT NULL AND round < {_STEPS})
        WINDOW w AS (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING))))
  WHERE NOT gone)
SELECT word, round, pos, token FROM step
QUALIFY round = max(round) OVER (PARTITION BY word)
ORDER BY word, pos
"""


class Ranks:
    """A rank file: the bytes of every token, and the pairs that can be contracted."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.byte_token = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [
            (ranks[whole[:k]], ranks[whole[k:]], rank)
            for whole, rank in ranks.items()
            for k in range(1, len(whole))
            if whole[:k] in ranks and whole[k:] in ranks
        ]
        first, second, rank = (np.array(c, dtype=np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, dtype=np.int64),) * 3
        # A token is free if no pair that it is part of has a lower rank than its own.
        bound = np.concatenate([first[rank < first], second[rank < second]])
        self.merges = pa.table({"pair": (first << 32) + second, "rank": rank, "free": ~np.isin(rank, bound)})
        spelled = sorted((rank, whole) for whole, rank in ranks.items())
        self.tokens = np.array([rank for rank, _ in spelled], dtype=np.int64)
        self.spellings = pa.array([whole for _, whole in spelled], pa.large_binary())

    @classmethod
    def from_file(cls, path: str) -> Ranks:
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        return cls({base64.b64decode(token): int(rank) for token, rank in lines})


class Codec:
    """Encoder and decoder of one task; what it remembers of words is bounded."""

    def __init__(self, ranks: Ranks, pattern: str):
        import duckdb
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.dense = np.array_equal(ranks.tokens, np.arange(len(ranks.tokens)))
        # Spills go to the task's own temporary folder and end with the connection.
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": _MEMORY, "temp_directory": tempfile.gettempdir()})
        self.sql.execute("SET preserve_insertion_order = false")
        self.sql.register("given_merges", ranks.merges)
        self.sql.execute("CREATE TABLE merges AS SELECT * FROM given_merges")
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.tokens = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def _query(self, query: str, **tables: pa.Table) -> pa.Table:
        for name, rows in tables.items():
            self.sql.register(name, rows)
        found = self.sql.sql(query).to_arrow_table()
        for name in tables:
            self.sql.unregister(name)
        return found

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words one after the other, tokens per word)."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), size)
        pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        token = self.ranks.byte_token[np.frombuffer(b"".join(words), dtype=np.uint8)]
        short = size[word] <= _SHORT
        follower = np.append(token[1:], _NONE)
        follower[np.cumsum(size)[size > 0] - 1] = _NONE
        pair = (token << 32) + follower
        done = [self._query(_CONTRACT_SHORT, start=pa.table({"key": word[short] * 64 + pos[short], "pair": pair[short]}))]
        state = pa.table({"word": word[~short], "pos": pos[~short], "token": token[~short]})
        while state.num_rows:
            reached = self._query(_CONTRACT_LONG, start=state)
            more = reached["round"].to_numpy() >= _STEPS
            done.append(reached.filter(pa.array(~more)).select(["word", "token"]))
            state = reached.filter(pa.array(more)).select(["word", "pos", "token"])
        word = np.concatenate([t["word"].to_numpy() for t in done])
        token = np.concatenate([t["token"].to_numpy() for t in done])
        order = np.argsort(word, kind="stable")
        return token[order], np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids per text)."""
        if len(self.index) > _HELD_WORDS:
            self._clear()
        lists = [self.pattern.findall(t) for t in texts]
        words = list(chain.from_iterable(lists))
        new = list(set(words).difference(self.index))
        if new:
            # A word that is a token as a whole is that token, whether merges lead to it or not.
            spelled = [w.encode() for w in new]
            whole = np.fromiter((self.ranks.ranks.get(w, -1) for w in spelled), dtype=np.int64, count=len(new))
            rest = np.flatnonzero(whole < 0)
            tokens, size = self.contract([spelled[i] for i in rest])
            order = np.concatenate([np.flatnonzero(whole >= 0), rest])
            new = [new[i] for i in order]
            tokens = np.concatenate([whole[whole >= 0], tokens])
            size = np.concatenate([np.ones(len(new) - len(rest), dtype=np.int64), size])
            self.first = np.concatenate([self.first, len(self.tokens) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.tokens = np.concatenate([self.tokens, tokens])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        rows = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        size = self.size[rows]
        owner = np.repeat(np.arange(len(texts)), [len(each) for each in lists])
        at = np.cumsum(size) - size
        out = self.tokens[np.arange(int(size.sum())) + np.repeat(self.first[rows] - at, size)]
        return out, np.bincount(owner, size, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Bytes of every text."""
        at = ids if self.dense else np.searchsorted(self.ranks.tokens, ids)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        spelled = pa.LargeListArray.from_arrays(ends, self.ranks.spellings.take(pa.array(at)))
        return pc.binary_join(spelled, pa.scalar(b"", pa.large_binary())).to_pylist()


def bpe_round_trip(docs: DataFrame, ranks: Ranks, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row: the ids of its whole text (little-endian 32 bits) and the bytes decoded from them.

    Null and empty texts have no ids.  Ids of rows may repeat or be null; other columns are left out.  Special
    tokens are ordinary text.  A task holds about two megabytes of texts at a time (more only for one longer
    text), the words it remembers, and a DuckDB with a fixed memory limit.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()),
         T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for batch in batches:
            texts = S.texts_of(batch.column(1))
            for lo, hi in S.chunks(texts):
                ids, sizes = codec.encode([t.decode("utf-8", "replace") for t in texts[lo:hi]])
                parts = [x.tobytes() for x in np.split(ids.astype("<u4"), np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(parts, pa.binary()),
                     pa.array(codec.decode(ids, sizes), pa.binary())],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)
