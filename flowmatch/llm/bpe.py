"""Byte-level BPE by DuckDB recursive queries inside Spark tasks.

Each task cuts its texts into pre-tokens.  Those it has not met yet become
token-position rows of a table; a recursive query joins neighbouring rows with
the merge table and contracts each word's leftmost pair of least rank, until
no word has a pair left.  Decoding joins token rows with the vocabulary and
aggregates their bytes in order of position.

A recursive round handles one merge of each word, and the query keeps the rows
of all its rounds, so a word's work and memory grow with the square of its
length.  Pre-tokens above ``BLOCK`` bytes are therefore merged in blocks by the
same query and joined at their seams.  Tokens are the encoding of a text if and
only if each two neighbours are the encoding of their own bytes: up to the
first merge across a boundary, whatever lies between two boundaries is merged
as it would be alone.  So a seam holds if the merged bytes of a few tokens on
its either side begin with the first and end with the last of these tokens;
where no such stretch is found, the next block is merged anew after the true
tokens before it.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmatch.llm.common import ship_code, text_or_empty
from flowmatch.llm.pretoken import cut, pieces, spread_out

BLOCK = 64            # bytes of a pre-token that are merged at once
SEAM = 4              # tokens on either side of a seam, at first
AHEAD = 64            # blocks merged before their seams are tried, at first
WORDS = 30_000        # words of one recursive query
SQUARES = 6_000_000   # squared bytes of all its words: twice the rows that it may keep
CACHED = 600_000      # pre-tokens whose ids a worker remembers
TOKENS = 400_000      # tokens of one decoding query
MEMORY = "400MB"      # most that DuckDB may take in a worker

# A pair's rank, place, right end and the place of its right token are packed in
# one number, 15 bits for each place: the least number of a word is its leftmost
# pair of least rank, and holds all that the contraction needs.
_ENCODE = """
WITH RECURSIVE t(w, pos, stop, tok, round) AS (
    SELECT w, pos, pos + 1, tok, 0 FROM start
  UNION ALL
    (WITH least AS (
        SELECT a.w, min((merged::BIGINT << 45) | (a.pos::BIGINT << 30) | (b.pos << 15) | b.stop) AS k
        FROM t a JOIN t b ON a.w = b.w AND a.stop = b.pos
        JOIN merges ON a.tok = merges.l AND b.tok = merges.r
        GROUP BY a.w)
    SELECT t.w, t.pos, CASE WHEN t.pos = (k >> 30) & 32767 THEN (k & 32767)::INT ELSE t.stop END,
           CASE WHEN t.pos = (k >> 30) & 32767 THEN (k >> 45)::INT ELSE t.tok END, round + 1
    FROM t JOIN least ON t.w = least.w WHERE t.pos <> (k >> 15) & 32767)
)
SELECT w, tok FROM t WHERE (w, round) IN (SELECT w, max(round) FROM t GROUP BY w) ORDER BY w, pos
"""
# Bytes stand as the characters of the same number while they are strings.
_DECODE = "SELECT doc, string_agg(piece, '' ORDER BY pos) FROM tokens JOIN vocabulary USING (tok) GROUP BY doc ORDER BY doc"


class Codec:
    """Encoder and decoder for one file of ranks, kept by a Python worker."""

    _own: dict[str, "Codec"] = {}

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t))
                  if t[:i] in self.ranks and t[i:] in self.ranks]
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.token = {r: t for t, r in self.ranks.items()}
        self.known: dict[bytes, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        pair_table = pa.table([pa.array(c, pa.int32()) for c in zip(*merges)], ["l", "r", "merged"])  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM pair_table")
        token_table = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM token_table")

    @classmethod
    def of(cls, path: str) -> "Codec":
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _merge_rows(self, words: list[bytes]) -> list[bytes]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        of = np.repeat(np.arange(len(words)), size)
        pos = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        start = pa.table([pa.array(x.astype(np.int32)) for x in (of, pos, self.byte[np.frombuffer(b"".join(words), np.uint8)])], ["w", "pos", "tok"])  # noqa: F841
        found = self.db.execute(_ENCODE).fetchnumpy()
        ids = found["tok"].astype("<u4").tobytes()
        ends = (4 * np.searchsorted(found["w"], np.arange(len(words)), "right")).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _merge(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word: few words at a time, so that the rows of a query stay bounded."""
        out, part, squares = {}, [], 0
        for w in words:
            if (r := self.ranks.get(w)) is not None:
                out[w] = r.to_bytes(4, "little")
                continue
            if part and (squares + len(w) ** 2 > SQUARES or len(part) == WORDS):
                out.update(zip(part, self._merge_rows(part)))
                part, squares = [], 0
            part.append(w)
            squares += len(w) ** 2
        if part:
            out.update(zip(part, self._merge_rows(part)))
        return out

    def _bytes(self, tokens: list[int]) -> bytes:
        return b"".join([self.token[t] for t in tokens])

    def _by_blocks(self, word: bytes):
        """Merge one long word: yields lists of pieces, is sent the ids of each
        piece, returns the word's ids."""
        done, at, ahead = [], 0, AHEAD  # done: the ids of word[:at]
        while at < len(word):
            blocks = [word[i:i + BLOCK] for i in range(at, min(len(word), at + ahead * BLOCK), BLOCK)]
            right = yield blocks
            left = [done, *right[:-1]]
            seams: dict[int, tuple] = {}
            size, untried = SEAM, [i for i in range(len(blocks)) if left[i]]
            while untried:
                # half of a block at most, so that the seams at its two ends stay apart
                sizes = [min(size, (len(left[i]) + 1) // 2, (len(right[i]) + 1) // 2) for i in untried]
                found = yield [self._bytes(left[i][-k:] + right[i][:k]) for i, k in zip(untried, sizes)]
                wider = []
                for i, k, ids in zip(untried, sizes, found):
                    if ids[0] == left[i][-k] and ids[-1] == right[i][k - 1]:
                        seams[i] = k, ids
                    elif k == size:
                        wider.append(i)
                size, untried = 2 * size, wider
            for i, ids in enumerate(right):
                if left[i] and i not in seams:
                    break
                k, between = seams.get(i, (0, []))
                if k:
                    del done[len(done) - k + 1:]
                    done += between[1:]
                done += ids[k:]
                at += len(blocks[i])
            else:
                ahead *= 2
                continue
            ahead, k = max(2, ahead // 2), SEAM
            while True:
                (ids,) = yield [self._bytes(done[-k:]) + blocks[i]]
                if k >= len(done) or ids[0] == done[-k]:
                    break
                k *= 2
            del done[max(0, len(done) - k):]
            done += ids
            at += len(blocks[i])
        return done

    def _merge_long(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of several blocks; the pieces of all go through the same queries."""
        out, steps = {}, {w: self._by_blocks(w) for w in words}
        wanted = {w: next(s) for w, s in steps.items()}
        ids: dict[bytes, list[int]] = {}
        while wanted:
            new = dict.fromkeys(p for some in wanted.values() for p in some if p not in ids)
            ids.update((p, np.frombuffer(x, "<u4").tolist()) for p, x in self._merge(list(new)).items())
            for w, some in list(wanted.items()):
                try:
                    wanted[w] = steps[w].send([ids[p] for p in some])
                except StopIteration as end:
                    out[w] = np.array(end.value, "<u4").tobytes()
                    del wanted[w]
        return out

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = words
        self.known.update(self._merge([w for w in new if len(w) <= BLOCK]))
        self.known.update(self._merge_long([w for w in new if len(w) > BLOCK]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        out = []
        for part in pieces(texts, 1_000_000):
            distinct, index, counts = cut(part)
            self.learn(distinct)
            each = [self.known[w] for w in distinct]
            values, ends = spread_out(np.frombuffer(b"".join(each), "<u4"), np.cumsum([0, *map(len, each)]) // 4, index)
            out += [x.tobytes() for x in np.split(values, ends[np.cumsum(counts)][:-1])]
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence; an id outside the vocabulary is an error."""
        out = [b""] * len(ids)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        if len(flat) and int(flat.max()) >= len(self.ranks):
            raise ValueError(f"id {flat.max()} is not in the vocabulary")
        of = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) // 4 for x in ids])
        for at in range(0, len(flat), TOKENS):
            tok = flat[at:at + TOKENS]
            tokens = pa.table([pa.array(x) for x in (of[at:at + TOKENS], np.arange(len(tok), dtype=np.int32), tok)], ["doc", "pos", "tok"])  # noqa: F841
            for doc, text in self.db.execute(_DECODE).fetchall():
                out[doc] += text.encode("latin-1")
        return out


def _per_batch(df: DataFrame, schema: str, convert) -> DataFrame:
    """Every row's first column with the columns that ``convert`` makes of the second."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            # few documents at a time: their ids and bytes stay bounded
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.binary()) for c in convert(part.column(1).to_pylist())]], names)

    ship_code(df.sparkSession)
    return df.mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs(doc_id, text, ...)``: the ids
    as little-endian 32-bit numbers in one binary value.

    A null or empty text has no ids.  Repeated rows stay repeated, null ids
    stay null, other columns are left out; an empty table stays empty.
    ``ranks_path`` is a file that every executor can open.
    """
    return _per_batch(_texts(docs), "doc_id long, ids binary", lambda texts: [Codec.of(ranks_path).encode(texts)])


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, bytes)`` of every row of ``encoded(doc_id, ids)``; null ids count as none."""
    rows = encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return _per_batch(rows, "doc_id long, bytes binary", lambda ids: [Codec.of(ranks_path).decode(ids)])


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, ids, bytes)``: ``encode`` and then ``decode`` of its ids, in one pass."""
    def both(texts):
        codec = Codec.of(ranks_path)
        ids = codec.encode(texts)
        return ids, codec.decode(ids)

    return _per_batch(_texts(docs), "doc_id long, ids binary, bytes binary", both)
