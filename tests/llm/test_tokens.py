import base64
import hashlib
import heapq
import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import zstandard
from tokenizers import Tokenizer

from flowmatch.llm import bpe, token_files, unigram
from flowmatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "a", "b", "the", "qu", "é", "中", "!!", "'s", "\n", " Z", "==", "00", "x" * 40, "ab" * 30, "<|endoftext|>", "\0"]
EDGES = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "z"), (7, "<|endoftext|>a<|endoftext|>"), (4, "long word " * 30000), (5, "=" * 3000), (6, "abcdetionrs" * 200)]


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 40))) for _ in range(200)] + [t or "" for _, t in EDGES]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, b"i") for r in EDGES], "doc_id long, text string, ids binary")


def ids_of(x):
    return np.frombuffer(x, "<u4").tolist()


def test_bpe_as_the_library(texts, library):
    codec = bpe.Codec(RANKS)
    found = codec.encode(texts)
    assert [ids_of(x) for x in found] == [library.encode_ordinary(t) for t in texts]
    assert codec.decode(found) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        codec.decode([struct.pack("<I", 50256)])


def test_blocks_and_whole_words_agree(texts):
    codec = bpe.Codec(RANKS)
    words = sorted({w.encode() for t in texts for w in regex.findall(public_tokenizers.PATTERN, t) if len(w) < 300})
    whole = dict(zip(words, codec._merge_rows(words)))
    assert codec._merge(words) == whole
    assert codec._merge_long(words) == whole  # of a word or a few blocks


@pytest.mark.parametrize("block", [3, 8, 21])
def test_bpe_small_memory(texts, library, monkeypatch, block):
    for name, value in (("CACHED", 5), ("WORDS", 30), ("SQUARES", 4000), ("TOKENS", 7), ("BLOCK", block), ("SEAM", 1), ("AHEAD", 2)):
        monkeypatch.setattr(bpe, name, value)
    some = [t for t in texts if len(t) < 20_000][:60]
    codec = bpe.Codec(RANKS)
    found = codec.encode(some)
    assert [ids_of(x) for x in found] == [library.encode_ordinary(t) for t in some]
    assert codec.decode(found) == [t.encode() for t in some]


LETTERS = "ACDEFGHIKLMNPQRSTVWY"
LONG_TEXTS = {
    "ideographs": lambda r: "，".join("".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(r.randrange(18, 81))) for _ in range(20_000))[:1_000_000],
    "sequences": lambda r: "\n".join("".join(r.choice(LETTERS) for _ in range(r.randrange(60, 251))) for _ in range(6_500))[:1_000_000],
    "one word": lambda r: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)),
    "base64": lambda r: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(300_000)),
    "pairs": lambda r: " " + "ha" * 100_001 + "xoxo" * 30_001,
    "one letter": lambda r: "a" * 200_003 + "=" * 100_001 + "-" * 77_777,
    "periods": lambda r: " ".join(p * (20_000 // len(p)) for p in ("abc", "lala", "12345", "the", "ing", "tion", "zyxwv", "нет", "中文")),
}


@pytest.mark.parametrize("name", LONG_TEXTS)
def test_bpe_long_words(library, name):
    """Long pre-tokens of all makes, within the worker's memory limit."""
    text = LONG_TEXTS[name](random.Random(7))
    codec = bpe.Codec(RANKS)
    (found,) = codec.encode([text])
    # the library takes time with the square of a word's length: it is asked where that is bearable
    words = regex.findall(public_tokenizers.PATTERN, text)
    if max(map(len, words)) < 50_000:
        assert ids_of(found) == library.encode_ordinary(text)
    else:
        assert ids_of(found) == [t for w in words for t in by_heap(codec.ranks, w.encode())]
    assert codec.decode([found]) == [text.encode()]


def by_heap(ranks, word):
    """Leftmost pair of least rank first, over linked tokens."""
    n = len(word)
    size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def push(i):
        j = after[i]
        if j < n and (r := ranks.get(word[i:j + size[j]])) is not None:
            heapq.heappush(heap, (r, i, j + size[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if size[i] and j < n and i + size[i] == j and j + size[j] == end:
            size[i], size[j], after[i] = size[i] + size[j], 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
    return [ranks[word[i:i + size[i]]] for i in range(n) if size[i]]


def test_by_heap_as_the_library(texts, ranks, library):
    for w in {w for t in texts[:80] for w in regex.findall(public_tokenizers.PATTERN, t)}:
        assert by_heap(ranks, w.encode()) == library.encode_ordinary(w)


def test_bpe_whole_table_and_edges(spark, edges, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_byte_bpe_round_trip"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    encoded = bpe.encode(edges, RANKS)
    got = sorted((r.doc_id or 0, ids_of(r.ids)) for r in encoded.collect())
    assert got == sorted((d or 0, library.encode_ordinary(t or "")) for d, t in EDGES)
    back = sorted((r.doc_id or 0, bytes(r.bytes)) for r in bpe.decode(encoded, RANKS).collect())
    assert back == sorted((d or 0, (t or "").encode()) for d, t in EDGES)
    assert bpe.round_trip(edges.limit(0), RANKS).count() == 0


def best_by_viterbi(score, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[b][0] + score[word[b:end]], best[b][1] - 1) for b in range(end) if word[b:end] in score))
    return -best[-1][1], best[-1][0]


def test_unigram_counts(spark, edges, texts):
    model = unigram.Unigram(RANKS)
    words = {w.encode() for t in texts for w in regex.findall(public_tokenizers.PATTERN, t) if len(w) < 200}
    found = model.terminals(list(words))
    assert found == {w: best_by_viterbi(model.score, w) for w in words}
    rows = {(r.doc_id, r.n_pretokens): (r.n_tokens, r.score) for r in unigram.token_counts(edges, RANKS).collect()}
    assert rows[1, 0] == rows[2, 0] == (0, 0.0) and rows[4, 60001][0] > 0 and len(rows) == 8
    assert unigram.token_counts(edges.limit(0), RANKS).count() == 0
    whole = {r.doc_id: r for r in QUERIES["op5_unigram_token_counts"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        parts = [best_by_viterbi(model.score, w.encode()) for w in regex.findall(public_tokenizers.PATTERN, d.text)[:400]]
        if len(parts) < 400:
            r = whole.pop(d.doc_id)
            assert (r.n_pretokens, r.n_tokens) == (len(parts), sum(n for n, _ in parts))
            assert abs(r.score - sum(s for _, s in parts)) < 1e-3


ADDED = "<|endoftext|>"


def test_model_ids_as_the_tokenizer(texts):
    whole = Tokenizer.from_file(JSON)
    texts = texts + [ADDED, ADDED * 2, f"{ADDED} a", f"a {ADDED}", f"a b {ADDED} c", f" {ADDED}\n\n{ADDED}  x", f"<|{ADDED}|>", ADDED[:-1], ADDED.upper(), f"é{ADDED}中"]
    assert any(50256 in whole.encode(t).ids for t in texts[:200])
    got = token_files.Tokens(JSON).ids(texts)
    assert [x.tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_file_format_and_random_access():
    class Sink(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    class Source(io.BytesIO):
        reads = 0

        def size(self):
            return len(self.getvalue())

        def read(self, n=-1):
            out = super().read(n)
            Source.reads += len(out)
            return out

    sink = Sink()
    writer, plain = token_files.Writer(sink), b""
    docs = [(d, np.arange(d * 50, dtype="<u4").tobytes()) for d in (3, 5, 9, 400)] + [(401, b"")]
    for d, ids in docs:
        writer.add(d, ids)
        plain += ids
    writer.close()
    assert list(token_files.read_documents(Source(sink.kept))) == [(d, sum(len(i) // 4 for e, i in docs if e < d), ids) for d, ids in docs]
    Source.reads = 0
    assert [(d, len(i)) for d, _, i in token_files.read_documents(Source(sink.kept), [5])] == [(5, 1000)]
    assert Source.reads < len(sink.kept) / 4  # other frames are not read
    # any decoder of zstandard streams reads it whole, past the skippable frames
    reader, out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.kept), read_across_frames=True), b""
    while chunk := reader.read(1 << 16):
        out += chunk
    assert out == plain
    hurt = bytearray(sink.kept)
    hurt[len(hurt) // 3] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.read_documents(Source(bytes(hurt))))


def test_files_whole_table_and_edges(spark, edges, tmp_path):
    whole = Tokenizer.from_file(JSON)
    rows = {r.doc_id: r for r in QUERIES["op6_token_id_files"](spark, SF).collect()}
    start = 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    for d in docs:
        ids = whole.encode(d.text, add_special_tokens=False).ids + [2]
        r = rows.pop(d.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not rows
    folder = f"file://{tmp_path}/ids"
    manifest = token_files.write(edges, folder, JSON, 2)
    got = sorted((r.doc_id, r.n_tokens) for r in token_files.read(manifest, folder).collect())
    assert got == sorted((d, len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in EDGES if d is not None)
    assert [r.doc_id for r in token_files.read(manifest, folder, [5, 77]).collect()] == [5]
    assert token_files.write(edges.limit(0), folder, JSON, 2).count() == 0
