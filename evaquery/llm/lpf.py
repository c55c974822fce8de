"""Exact repeats by longest-previous-factor arrays over buckets of suffixes.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with
a smaller id. A suffix array of a whole corpus is one sorted list of all its bytes; here
the suffixes are dealt into buckets first, so that two that agree on ``length`` bytes
always meet:

* of the ``kmer``-byte strings inside a window of ``length`` bytes the one with the least
  hash is its anchor; equal windows have equal anchors at equal places. Neighbouring
  windows mostly share theirs, and those that do are one chunk, about a text's length / 16;
* anchors that occur once in the corpus are told by a count of hashes, without any text;
* the chunks of the others are collected once each with the least id that has them. A
  document with a greater id loses all windows of such a chunk;
* chunks that share an anchor without being equal share windows in part: their suffixes
  are sorted, and the previous and next smaller ids in suffix order give, with the common
  prefixes between, the longest match with an earlier document.

Copies of a text are one text with the least of their ids; the rest of them is removed whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cleaned_shuffles, scratch, sliced, small, stored, texts

#: Bytes of text that are hashed in one go; a longer text is taken in pieces that overlap by a window.
BLOCK = 1 << 20
#: Chunks of one anchor that are sorted in one task; the windows of the others are compared by a grouping.
BUCKET = 20_000
#: Bytes of chunks that are sorted in one go, whole buckets each.
SORTED = 1 << 21
#: A null id counts as the greatest.
LAST = (1 << 63) - 1

#: Two hashes that tell a text.
TEXT = ["row", "twin"]

_PLACE = (1 << 24) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Hashes of any substrings of a buffer, from prefix sums of its bytes times powers of an odd number modulo 2 ** 64."""

    _powers = _inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, buffer: np.ndarray) -> None:
        n = len(buffer)
        if len(Sums._powers) < n:
            for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                each = np.full(n, np.uint64(base), dtype=np.uint64)
                each[0] = 1
                setattr(Sums, name, np.cumprod(each))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[buffer] * Sums._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * Sums._inverse[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        return _mixed((self.sums[size:] - self.sums[:-size]) * Sums._inverse[: len(self.sums) - size])


class Block(NamedTuple):
    """Pieces of texts in one buffer: of which text, from which byte of it, and where in the buffer."""

    raw: bytes
    text: np.ndarray
    base: np.ndarray
    start: np.ndarray
    end: np.ndarray


def blocks(bodies: list[bytes], length: int) -> Iterator[Block]:
    """The texts of ``length`` bytes or more, in blocks of about BLOCK bytes; a window start is in one piece only."""
    pieces: list[tuple[int, int, bytes]] = []
    size = 0

    def packed() -> Block:
        ends = np.cumsum([len(p[2]) for p in pieces])
        return Block(b"".join(p[2] for p in pieces), np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces]), ends - [len(p[2]) for p in pieces], ends)

    for i, body in enumerate(bodies):
        for at in range(0, len(body) - length + 1, BLOCK):
            pieces.append((i, at, body[at : at + BLOCK + length - 1]))
            size += len(pieces[-1][2])
            if size >= BLOCK:
                yield packed()
                pieces, size = [], 0
    if pieces:
        yield packed()


class Chunks(NamedTuple):
    """Runs of windows with one anchor: piece of the block, first and last window start in the buffer, anchor's and own hash."""

    piece: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    own: np.ndarray


def chunks(block: Block, length: int, kmer: int) -> Chunks:
    buffer = np.frombuffer(block.raw, dtype=np.uint8)
    sums, n = Sums(buffer), len(buffer)
    hashes = sums.windows(kmer)
    least = (hashes & np.uint64(~_PLACE & ((1 << 64) - 1))) | np.arange(len(hashes), dtype=np.uint64)
    width, span = length - kmer + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & np.uint64(_PLACE)).astype(np.int64)
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[block.start] += 1
    inside[block.end - length + 1] -= 1
    valid = np.cumsum(inside[: n - length + 1], dtype=np.int8) > 0
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(opens)
    closes = valid.copy()
    closes[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    last = np.flatnonzero(closes)
    return Chunks(np.searchsorted(block.start, first, side="right") - 1, first, last, hashes[anchor[first]], sums.of(first, last + length))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _per_text(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """The blocks of the column text of each batch, with the rows they are numbered by."""
    for batch in batches:
        for part in sliced(batch):
            for block in blocks(part.column("text").cast(pa.binary()).to_pylist(), length):
                yield part, block


def anchors(rows: DataFrame, length: int, kmer: int, keyed: bool) -> DataFrame:
    """(h) or (h, row): the anchors of every text, each once a piece of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _per_text(batches, length):
            found = chunks(block, length, kmer)
            order = np.lexsort((found.anchor, found.piece))
            h, piece = found.anchor[order], found.piece[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (piece[1:] != piece[:-1])
            columns = [_signed(h[new])]
            if keyed:
                columns.append(part.column("row").take(pa.array(block.text[piece[new]])))
            yield pa.RecordBatch.from_arrays(columns, names=["h", "row"][: len(columns)])

    if keyed:
        return rows.select("row", "text").mapInArrow(run, "h bigint, row bigint")
    return rows.select("text").mapInArrow(run, "h bigint")


def shared_chunks(rows: DataFrame, length: int, kmer: int) -> DataFrame:
    """(row, twin, first, h, c, chunk): the chunks of texts (row, twin, id, first, hs, text) whose anchor is in ``hs``.

    Only of rows that have the least id of their text; c is the chunk's own hash.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _per_text(batches, length):
            found = chunks(block, length, kmer)
            hs, take = part.column("hs"), np.zeros(len(found.first), dtype=bool)
            ends = np.searchsorted(found.piece, np.arange(len(block.text)), side="right")
            for piece, (text, a, b) in enumerate(zip(block.text.tolist(), [0, *ends[:-1].tolist()], ends.tolist())):
                take[a:b] = np.isin(found.anchor[a:b].view(np.int64), hs[text].values.to_numpy(zero_copy_only=False))
            piece, first, last = found.piece[take], found.first[take], found.last[take] + length
            at = pa.array(block.text[piece])
            bodies = [block.raw[i:j] for i, j in zip(first.tolist(), last.tolist())]
            columns = [*(part.column(c).take(at) for c in ("row", "twin", "first")), _signed(found.anchor[take]), _signed(found.own[take]), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "twin", "first", "h", "c", "chunk"])

    return rows.where("id = first").select("row", "twin", "first", "hs", "text").mapInArrow(run, "row bigint, twin bigint, first bigint, h bigint, c bigint, chunk binary")


def longest_previous(ids: list[int], common: list[int]) -> list[int]:
    """For each suffix, in suffix order, the longest prefix it shares with a suffix of a smaller id.

    ``common[i]`` is the longest common prefix of suffix i and the one before. It falls
    with the distance, so the nearest smaller id before and the nearest one after do.
    """

    def before(pairs: Iterable[tuple[int, int]]) -> list[int]:
        stack: list[tuple[int, int]] = []
        out = []
        for own, shared in pairs:
            while stack and stack[-1][0] >= own:
                shared = min(shared, stack.pop()[1])
            out.append(shared if stack else 0)
            stack.append((own, shared))
        return out

    back = before(zip(reversed(ids), [0, *reversed(common[1:])]))
    return [max(x) for x in zip(before(zip(ids, common)), reversed(back))]


def earlier_windows(bodies: list[bytes], ids: list[int], length: int) -> np.ndarray:
    """A bit mask a chunk: its windows (bit 0 the first) that a chunk of a smaller id has too.

    Only windows whose hash occurs twice are sorted as suffixes.
    """
    raw = b"".join(bodies)
    buffer = np.frombuffer(raw, dtype=np.uint8)
    sizes = np.array([len(b) for b in bodies])
    starts = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(bodies)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[owner] + place
    hashes = Sums(buffer).windows(length)[at]
    _, code, times = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[code] > 1)
    masks = np.zeros(len(bodies), dtype=np.int64)
    if not len(twice):
        return masks
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buffer, length)[at[twice]])
    own = np.array(ids, dtype=np.int64)[owner[twice]]
    order = np.lexsort((own, suffixes.view(f"S{length}").ravel()))
    unlike = suffixes[order][1:] != suffixes[order][:-1]
    common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), length)
    longest = np.array(longest_previous(own[order].tolist(), [0, *common.tolist()]))
    hit = twice[order[longest >= length]]
    np.bitwise_or.at(masks, owner[hit], np.left_shift(np.int64(1), place[hit]))
    return masks


def partial_matches(distinct: DataFrame, length: int, bucket: int) -> DataFrame:
    """(h, c, mask): what ``earlier_windows`` finds in the buckets of ``distinct`` (h, c, chunk, least).

    A bucket, the chunks of one anchor, is sorted in one task up to ``bucket`` of them. The
    windows of larger ones are grouped instead, with a minimum before the shuffle.
    """
    large = stored(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("h"))
    dealt = distinct.join(small(large), "h", "left_anti").repartition("h").sortWithinPartitions("h")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in _ended(batches):
            if batch is not None:
                rest.append(batch)
                if sum(b.nbytes for b in rest) < SORTED:
                    continue
            if not rest:
                return
            whole = pa.Table.from_batches(rest)
            h = whole["h"].to_numpy()
            edge = len(h) if batch is None else int(np.searchsorted(h, h[-1]))
            own, rest = whole.slice(0, edge), whole.slice(edge).combine_chunks().to_batches()
            if not edge:
                continue
            h = h[:edge]
            mixed = np.zeros(edge, dtype=bool)
            mixed[1:] |= h[1:] == h[:-1]
            mixed[:-1] |= h[1:] == h[:-1]
            own = own.filter(pa.array(mixed))
            masks = earlier_windows(own["chunk"].to_pylist(), own["least"].to_pylist(), length) if own.num_rows else np.zeros(0, dtype=np.int64)
            hit = masks != 0
            yield pa.RecordBatch.from_arrays([own[c].combine_chunks().filter(pa.array(hit)) if own.num_rows else pa.array([], pa.int64()) for c in ("h", "c")] + [pa.array(masks[hit])], names=["h", "c", "mask"])

    found = dealt.select("h", "c", "chunk", "least").mapInArrow(run, "h bigint, c bigint, mask bigint")
    if large.isEmpty():
        return found
    places = F.sequence(F.lit(0), F.octet_length("chunk") - length)
    each = distinct.join(small(large), "h").select("h", "c", "least", "chunk", F.explode(places).alias("place")).select("h", "c", "least", "place", F.expr(f"substring(chunk, place + 1, {length})").alias("window"))
    first = each.groupBy("window").agg(F.min("least").alias("earliest"), F.max("least").alias("latest")).where("earliest < latest").drop("latest")
    hit = each.join(stored(first), "window").where("earliest < least")
    return found.unionByName(hit.groupBy("h", "c").agg(F.expr("bit_or(shiftleft(1L, place))").alias("mask")))


def _ended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def repeats(rows: DataFrame, length: int, kmer: int, bucket: int) -> DataFrame:
    """(row, twin, first, marks): for each text (row and twin: its hashes) of ``rows`` (row, twin, id, text) the least
    id that has it, and the chunks (c) of it with windows that an earlier document has (mask; -1: all), null if none."""
    with scratch(rows.sparkSession), cleaned_shuffles(rows.sparkSession):
        first = stored(rows.groupBy(*TEXT).agg(F.min("id").alias("first")))
        shared = stored(anchors(rows, length, kmer, False).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
        met = stored(anchors(rows, length, kmer, True).join(shared.hint("shuffle_hash"), "h"))
        lists = met.groupBy("row").agg(F.collect_set("h").alias("hs"))
        wanted = stored(lists.join(first, "row"))
        own = stored(shared_chunks(rows.join(wanted.hint("shuffle_hash"), TEXT), length, kmer))
        distinct = stored(own.groupBy("h", "c", "chunk").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")))
        partial = partial_matches(distinct, length, bucket)
        known = distinct.select("h", "c", "least", "n").join(partial, ["h", "c"], "left").where("n > 1 or mask is not null")
        known = stored(known.select("h", "c", "least", F.coalesce("mask", F.lit(0)).alias("mask")))
        verdict = F.when(F.col("first") > F.col("least"), F.lit(-1).cast("bigint")).otherwise(F.col("mask"))
        hits = stored(own.select(*TEXT, "first", "h", "c").join(known.hint("shuffle_hash"), ["h", "c"]).select(*TEXT, "c", verdict.alias("mask")).where("mask <> 0"))
        marks = hits.groupBy(*TEXT).agg(F.collect_set(F.struct("c", "mask")).alias("marks"))
        return stored(first.join(marks, TEXT, "left"), keep=True)


def covered(body: bytes, marks: dict[int, int], length: int, kmer: int) -> np.ndarray:
    """Whether each byte is in a marked window."""
    edges = np.zeros(len(body) + 1, dtype=np.int64)
    c = np.sort(np.fromiter(marks, dtype=np.int64))
    for block in blocks([body], length):
        found = chunks(block, length, kmer)
        own = found.own.view(np.int64)
        hit = np.flatnonzero(np.isin(own, c))
        shift = block.base[found.piece[hit]] - block.start[found.piece[hit]]
        masks = np.array([marks[x] for x in own[hit].tolist()], dtype=np.int64)
        first, last, whole = found.first[hit] + shift, found.last[hit] + shift, masks == -1
        np.add.at(edges, first[whole], 1)
        np.add.at(edges, last[whole] + length, -1)
        for mask, a, b in zip(masks[~whole].tolist(), first[~whole].tolist(), last[~whole].tolist()):
            starts = [a + k for k in range(b - a + 1) if mask >> k & 1]
            edges[starts] += 1
            edges[[x + length for x in starts]] -= 1
    return np.cumsum(edges[:-1]) > 0


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, kmer: int = 20, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start,end>>, kept binary): a row for each row of ``docs``.

    ``spans`` are the maximal runs of removed bytes of the UTF-8 text, ``kept`` the others.
    A byte goes if a string of ``length`` bytes covers it that also starts in a document
    with a smaller id; strings are judged on the input and do not cross documents. Of a
    group the first keeps its text. A null text is an empty one, a null id counts as the
    greatest; rows of one id are no earlier than each other; an empty table gives no rows.
    A text is worked on in pieces of BLOCK bytes, so its length costs time, not memory
    beyond a few times its own. Chunks are told by 128 bits of hash, windows of unequal
    chunks by their bytes.
    """
    if not (kmer < length and length - kmer < 62):
        raise ValueError("a chunk's windows must fit a mask: length - kmer is 1 to 61")
    own = texts(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("row"), F.xxhash64(F.lit(1), F.col("text")).alias("twin"), F.coalesce("doc_id", F.lit(LAST)).alias("id"))
    found = repeats(own.select(*TEXT, "id", "text"), length, kmer, bucket)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                spans, kept, sizes = [], [], []
                for own_id, first, marks, body in zip(*(part.column(c).to_pylist() for c in ("id", "first", "marks")), part.column("text").cast(pa.binary()).to_pylist()):
                    gone = np.zeros(len(body), dtype=bool)
                    if own_id > first:
                        gone[:] = len(body) >= length
                    elif marks:
                        gone = covered(body, {m["c"]: m["mask"] for m in marks}, length, kmer)
                    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                    spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                    kept.append(np.frombuffer(body, dtype=np.uint8)[~gone].tobytes())
                    sizes.append(len(body))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = own.join(found.hint("shuffle_hash"), TEXT, "left").select("doc_id", "id", F.coalesce("first", "id").alias("first"), "marks", "text")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def repeat_report(kept: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what ``without_repeats`` gives."""
    removed: Column = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
