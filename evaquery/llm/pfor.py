"""Token ids in files of patched frame-of-reference blocks.

A shard holds the ids of whole documents. Ids are cut into blocks of 128; a block
stores its minimum, packs the differences at the width of their 90th percentile and
lists wider ones as exceptions. An index of block starts lets any block be read alone.

Layout, little-endian: "PFOR" | version u16 | block length u16 | documents u32 |
blocks u32 | ids u64 | document ids i64 each | null flags u8 each | lengths u32 each |
block starts u32 each (from the first block) | blocks. A block: minimum u32 | width u8 |
exceptions u8 | 128 differences at that width in 64-bit words | exception positions u8
each | exception differences u32 each.

Shards are written as rows of a Parquet table (partition, running start, counts,
shard bytes), so that Spark's committer makes each appear once and whole on any file
system even when executors are lost; ``shard`` and ``unshard`` are the bytes themselves.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import SPACED, Cached, library_tokenizer
from .common import shared_dir, sliced, small_batches, texts

BLOCK = 128
PERCENTILE = 90
SHARD_IDS = 1 << 20
_HEAD = struct.Struct("<4sHHIIQ")
_FIXED = 6


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) differences below 2**width as (blocks, 16 * width) bytes."""
    lanes = np.ascontiguousarray(values.T).astype(np.uint64)
    words = np.zeros((2 * width, values.shape[0]), dtype=np.uint64)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").T)
    mask = np.uint64((1 << width) - 1)
    out = np.zeros((BLOCK, packed.shape[0]), dtype=np.uint32)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[word + 1] << np.uint64(64 - shift))
        out[i] = x & mask
    return out.T


def shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one shard: documents in order, ``ids`` (unsigned 32-bit) end to end."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, dtype=np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    rows = padded.reshape(blocks, BLOCK)
    least = rows.min(axis=1) if blocks else np.zeros(0, dtype=np.uint32)
    diff = rows - least[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    high = np.partition(diff, rank, axis=1)[:, rank] if blocks else least
    width = np.ceil(np.log2(high.astype(np.float64) + 1)).astype(np.int64)
    odd = diff.astype(np.uint64) >> width[:, None].astype(np.uint64) != 0
    n_odd = odd.sum(axis=1)
    sizes = _FIXED + 16 * width + 5 * n_odd
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    body = np.zeros(starts[-1], dtype=np.uint8)
    at = starts[:-1]
    body[at[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    body[at + 4], body[at + 5] = width, n_odd
    plain = np.where(odd, np.uint32(0), diff)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        body[at[own][:, None] + _FIXED + np.arange(16 * w)] = _pack(plain[own], int(w))
    r, c = np.nonzero(odd)
    nth = np.arange(len(r)) - np.concatenate([[0], np.cumsum(n_odd)])[r].astype(np.int64)
    tail = at[r] + _FIXED + 16 * width[r]
    body[tail + nth] = c
    body[(tail + n_odd[r] + 4 * nth)[:, None] + np.arange(4)] = diff[r, c].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = _HEAD.pack(b"PFOR", 1, BLOCK, len(doc_ids), blocks, n)
    return b"".join([
        head, np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), bytes(d is None for d in doc_ids),
        np.array(lengths, dtype="<u4").tobytes(), at.astype("<u4").tobytes(), body.tobytes(),
    ])


def unshard(data: bytes, blocks: slice | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a shard; with ``blocks``, only the ids of those blocks."""
    magic, version, block, docs, n_blocks, n = _HEAD.unpack_from(data)
    if (magic, version, block) != (b"PFOR", 1, BLOCK):
        raise ValueError("not a shard of this format")
    at = _HEAD.size
    ids = np.frombuffer(data, "<i8", docs, at)
    nulls = data[at + 8 * docs : at + 9 * docs]
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    index = at + 13 * docs
    start = np.frombuffer(data, "<u4", n_blocks, index).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=index + 4 * n_blocks)
    chosen = np.arange(n_blocks)[blocks or slice(None)]
    start = start[chosen]
    least = np.ascontiguousarray(body[start[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    width, n_odd = body[start + 4].astype(np.int64), body[start + 5].astype(np.int64)
    diff = np.zeros((len(start), BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        diff[own] = _unpack(body[start[own][:, None] + _FIXED + np.arange(16 * w)], int(w))
    r = np.repeat(np.arange(len(start)), n_odd)
    nth = np.arange(len(r)) - (np.cumsum(n_odd) - n_odd)[r]
    tail = start[r] + _FIXED + 16 * width[r]
    if len(r):
        wide = np.ascontiguousarray(body[(tail + n_odd[r] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        diff[r, body[tail + nth]] = wide
    out = (diff + least[:, None]).reshape(-1)
    whole = out[:n] if blocks is None else out[: max(0, min(len(out), n - int(chosen[0]) * BLOCK if len(chosen) else 0))]
    return [None if z else int(d) for d, z in zip(ids, nulls)], lengths, whole


#: The normaliser and the split of a lower-casing, word-end BPE, as its file states them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: That split within lower-case Latin-1, where no sign composes and case maps one to one; apostrophes aside.
_PARTS = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\t-\\r \\x85\\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
MOST_PARTS = 600_000


class Encoder:
    """Texts to little-endian 16- or 32-bit ids, exactly as the library gives them.

    In general a text goes to the library by pieces. Where the tokenizer's file states
    NORMALIZERS and SPLIT, texts within Latin-1 are lower-cased and cut into pre-tokens;
    each distinct one of a call is looked up once, and only a new one meets the BPE model.
    """

    def __init__(self, path: str) -> None:
        self.library = library_tokenizer(path)
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.pieces = Cached(lambda p: [self._bytes(e.ids) for e in self.library.encode_batch_fast(p, add_special_tokens=False)])
        self.parts = Cached(self._parts, MOST_PARTS)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        steps = (said["normalizer"] or {}).get("normalizers", [])
        splits = [x.get("pattern", {}).get("Regex") for x in (said["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_words = steps == NORMALIZERS and splits == [SPLIT, None]
        self.not_plain = ("'", *(x["content"].lower() for x in said["added_tokens"]))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.kind.char, ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype=self.kind).tobytes()

    def _parts(self, parts: list[str]) -> list[bytes]:
        tokenize, letter = self.library.model.tokenize, self.letters.__getitem__
        return [self._bytes([t.id for t in tokenize(p if p.isascii() and p.isalpha() else "".join(map(letter, p.encode())))]) for p in parts]

    def _by_words(self, lower: list[str]) -> list[np.ndarray]:
        lists = list(map(_PARTS.findall, lower))
        parts = pa.array(chain.from_iterable(lists), pa.string(), size=sum(map(len, lists))).dictionary_encode()
        at = parts.indices.to_numpy()
        values = self.parts.distinct(parts.dictionary.to_pylist())
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // self.kind.itemsize
        ids = np.frombuffer(b"".join(values), dtype=self.kind)
        own = sizes[at]
        ends = np.concatenate([[0], np.cumsum(own)])
        out = ids[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], own) + np.arange(ends[-1])]
        cuts = ends[np.cumsum([0, *map(len, lists)])]
        return [out[i:j] for i, j in zip(cuts, cuts[1:])]

    def forget(self) -> None:
        """Lets an idle worker hold no more than the tokenizer."""
        self.parts.clear()
        self.pieces.clear()
        pa.default_memory_pool().release_unused()

    def encode(self, texts_: list[str]) -> list[np.ndarray]:
        lower = [t.lower() for t in texts_] if self.by_words else texts_
        plain = [self.by_words and _within_latin(t) and not any(x in low for x in self.not_plain) for t, low in zip(texts_, lower)]
        by_word = iter(self._by_words([low for low, p in zip(lower, plain) if p]) if any(plain) else ())
        by_piece = iter(self.pieces.values([SPACED.findall(t) for t, p in zip(texts_, plain) if not p]))
        return [next(by_word) if p else np.frombuffer(b"".join(next(by_piece)), dtype=self.kind) for p in plain]


def _within_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@cache
def _encoder(path: str) -> Encoder:
    """One tokenizer and its caches a worker."""
    return Encoder(path)


def encoded(texts_: list[str], path: str) -> list[np.ndarray]:
    """Ids of whole texts, as the tokenizers library gives them."""
    return _encoder(path).encode(texts_)


FILES = "part int, start bigint, n_docs bigint, n_ids bigint, shard binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of ``docs`` in ascending doc_id order to shards under ``path``.

    Rows are range-partitioned by doc_id, and by how their text begins where they share
    one, and sorted (nulls first, ties by text); a task streams its range and holds one
    shard's ids, about a million, or one document's, however long.
    A null text counts as empty and has only the end id, if there is one.
    """
    dealt = texts(docs, id_col, text_col).repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    ending = np.zeros(0, dtype=np.uint32) if end_id is None else np.array([end_id], dtype=np.uint32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, held, ids, n = TaskContext.get().partitionId(), 0, [], [], 0

        def flushed() -> pa.RecordBatch:
            whole = np.concatenate(ids).astype(np.uint32)
            data = shard([d for d, _ in held], [k for _, k in held], whole)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([v], pa.int64()) for v in (start, len(held), n)), pa.array([data], pa.binary())], names=["part", "start", "n_docs", "n_ids", "shard"])

        for batch in batches:
            for some in sliced(batch):
                for doc_id, own in zip(some.column(0).to_pylist(), encoded(some.column(1).to_pylist(), tokenizer)):
                    ids += (own, ending)
                    held.append((doc_id, len(own) + len(ending)))
                    n += held[-1][1]
                    if n >= SHARD_IDS:
                        yield flushed()
                        start, held, ids, n = start + n, [], [], 0
        if held:
            yield flushed()
        _encoder(tokenizer).forget()

    with small_batches(docs.sparkSession, 2500):
        dealt.mapInArrow(run, FILES).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards under ``path``.

    Ranges are few, one a task of the writer, so their starts are summed in one place
    and broadcast; documents are decoded where their shard is read.
    """
    files = spark.read.schema(FILES).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_ids, lengths, ids = unshard(data)
                ends = np.cumsum(lengths.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["part", "doc_id", "own", "n_tokens", "ids_crc32"])

    rows = files.select("part", "start", "shard").mapInArrow(run, "part int, doc_id bigint, own bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` as token-id shards and returns what the files say of each document.

    One row for each row of ``docs``: start (ids of all documents before it in ascending
    doc_id order), n_tokens (with the end id) and the crc32 of its ids as little-endian
    unsigned 32-bit integers. A null text has the end id alone; null doc_ids come first and
    stay null; rows that share a doc_id follow each other in order of their text; an empty
    table writes no shard and gives no rows.
    """
    spark = docs.sparkSession
    if path is None:
        import uuid

        path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id, id_col, text_col)
    return read(spark, path)
