"""Token-id files: independent zstandard frames with a trailing seek table.

A file holds the documents of one range of doc_ids in ascending order:

    one zstandard frame for each document: its ids, little-endian unsigned 32 bit
    one skippable frame, the directory: doc_ids and token counts, both 64 bit
    one skippable frame, the seek table of the public zstd seekable format:
        for each frame its compressed size, its plain size and the low 32 bits
        of its XXH64; then the number of frames, a descriptor and a magic number

Any zstandard decoder reads the whole file; a reader that wants some documents
takes the end of the file, finds their frames and decompresses only these.
Files are written under attempt-unique names and named by the manifest that
the write returns, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmatch.llm.common import kept, ship_code, slots, text_or_empty
from flowmatch.llm.pretoken import cut, pieces, spread_out

SKIPPABLE_DIRECTORY, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CACHED = 600_000     # pre-tokens whose ids a worker remembers
READ_BYTES = 8 << 20  # ids handed to Spark at a time


class Tokens:
    """Ids of texts by a byte-level tokenizer file, one encoding of each
    pre-token.  The tokenizer cuts texts at its added tokens, which have ids of
    their own, splits what is left by ``public_tokenizers.PATTERN``, and its
    model merges each part by itself, so equal parts have equal ids.  The
    model is called with parts in the byte-level alphabet."""

    _own: dict[str, "Tokens"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model = whole.model
        added = whole.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.added = {t.content: np.array([i], "<u4") for i, t in added.items() if t.content}
        # the longest of those that begin at a place
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[bytes, bytes] = {}  # ids as little-endian 32 bit
        # the byte-level alphabet: printable bytes are their own character, the others follow 255 in order
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in own]
        self.alphabet = {b: 256 + k for k, b in enumerate(others)}

    @classmethod
    def of(cls, path: str) -> "Tokens":
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def learn(self, parts: list[bytes]) -> None:
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = parts
        letters = b"".join(new).decode("latin-1").translate(self.alphabet)
        at, tokenize = 0, self.model.tokenize
        for part in new:
            found = tokenize(letters[at:at + len(part)])
            self.known[part] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
            at += len(part)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library's ``encode(..., add_special_tokens=False)``."""
        split = [self.cut.split(t) if self.cut and any(a in t for a in self.added) else [t] for t in texts]
        found = iter(self._plain([p for parts in split for p in parts[::2]]))
        # every second part is an added token
        return [next(found) if len(parts) == 1 else np.concatenate([self.added[p] if k % 2 else next(found) for k, p in enumerate(parts)])
                for parts in split]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for part in pieces(texts):
            distinct, index, counts = cut(part)
            self.learn(distinct)
            each = [self.known[p] for p in distinct]
            offsets = np.cumsum([0, *map(len, each)]) // 4
            values, ends = spread_out(np.frombuffer(b"".join(each), "<u4"), offsets, index)
            out += np.split(values, ends[np.cumsum(counts)][:-1])
        return out


class Writer:
    """Writes one file to an open binary sink."""

    def __init__(self, sink, level: int = 1):
        self.sink, self.doc_ids, self.counts, self.seek = sink, [], [], []
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress

    def add(self, doc_id: int, ids: bytes) -> None:
        frame = self.compress(ids)
        self.sink.write(frame)
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.seek.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))

    def close(self) -> None:
        directory = np.array(self.doc_ids, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes()
        table = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE)
        for magic, body in ((SKIPPABLE_DIRECTORY, directory), (SKIPPABLE_SEEK, table)):
            self.sink.write(struct.pack("<II", magic, len(body)) + body)
        self.sink.close()


def read_documents(source, wanted=None):
    """Yield ``(doc_id, ids of the documents before it, ids as bytes)`` from an
    open file: of all documents, or of the doc_ids in ``wanted``.  Only their
    frames are read and decompressed, and each is held against its checksum."""
    size = source.size()
    source.seek(size - 9)
    n, descriptor, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE or descriptor != 0x80:
        raise ValueError("no seek table")
    table_at = size - 9 - 12 * n
    source.seek(table_at)
    table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
    source.seek(table_at - 8 - 16 * n)
    doc_ids, counts = np.frombuffer(source.read(16 * n), "<i8").reshape(2, n)
    at = np.cumsum(table[:, 0].astype(np.int64)) - table[:, 0]
    before = np.cumsum(counts) - counts
    decompress = zstandard.ZstdDecompressor().decompress
    chosen = range(n) if wanted is None else np.flatnonzero(np.isin(doc_ids, list(wanted))).tolist()
    for k in chosen:
        source.seek(int(at[k]))
        ids = decompress(source.read(int(table[k, 0])), max_output_size=int(table[k, 1]))
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != table[k, 2] or len(ids) != 4 * counts[k]:
            raise ValueError(f"damaged frame {k} of document {doc_ids[k]}")
        yield int(doc_ids[k]), int(before[k]), ids


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the token ids of all ``docs(doc_id, text, ...)`` into files below
    ``folder`` in ascending doc_id order; return the manifest ``(range, file,
    n_docs, n_tokens, start)``, checkpointed.

    Each document ends with ``end_id``; a null or empty text has only that.
    Repeated rows are repeated documents; rows with a null doc_id can't be
    asked for and are left out.  An empty table gives an empty manifest.
    ``folder`` is a URI or path of a file system that pyarrow opens on the
    executors.
    """
    spark = docs.sparkSession
    ship_code(spark)
    def run(batches):
        from pyspark import TaskContext

        tokens, part = Tokens.of(tokenizer_path), TaskContext.get().partitionId()
        file, end, writer = f"{part:06d}-{uuid.uuid4().hex}.ids", struct.pack("<I", end_id), None
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), tokens.ids(b.column(1).to_pylist())):
                if writer is None:
                    where, path = fs.FileSystem.from_uri(folder)
                    where.create_dir(path)
                    writer = Writer(where.open_output_stream(f"{path}/{file}"))
                writer.add(doc, ids.tobytes() + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"range": part, "file": file, "n_docs": len(writer.counts), "n_tokens": sum(writer.counts)}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where("doc_id is not null")
    ordered = rows.repartitionByRange(slots(spark), "doc_id").sortWithinPartitions("doc_id")
    manifest = kept(ordered.mapInArrow(run, "range long, file string, n_docs long, n_tokens long"))
    # one row for each file: their running sum is small
    before = F.sum("n_tokens").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    return kept(manifest.withColumn("start", F.coalesce(before, F.lit(0).cast("long"))))


def read(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """Documents of the files in a manifest: ``doc_id, start, n_tokens, ids``
    (``start``: ids of all documents before it; ``ids``: little-endian bytes).
    With ``wanted`` only the frames of these doc_ids are decompressed."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                where, path = fs.FileSystem.from_uri(folder)
                with where.open_input_file(f"{path}/{row['file']}") as source:
                    part, size = [], 0
                    for doc, before, ids in read_documents(source, wanted):
                        part.append({"doc_id": doc, "start": row["start"] + before, "n_tokens": len(ids) // 4, "ids": ids})
                        size += len(ids)
                        if size > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(part)
                            part, size = [], 0
                    if part:
                        yield pa.RecordBatch.from_pylist(part)

    spark = manifest.sparkSession
    ship_code(spark)
    return manifest.repartition(slots(spark), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
