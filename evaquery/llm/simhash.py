"""SimHash near-duplicates: fingerprints, blocks that close pairs share, exact Hamming verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cleaned_shuffles, col, free_name, joined_by, scratch, sliced, small, stored, texts
from .graph import connected_components

SEED = 42
BITS = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMNS = np.arange(8, dtype=np.int64) * 256


#: Distinct fingerprints of one bucket that are compared in one go; a larger bucket is cut into chunks and compared chunk by chunk.
CHUNK = 1 << 17
#: Bytes of a wide fingerprint that go to its buckets.
SHORT = 16
#: Bytes of shingle sets that are compared in one go; a larger group is cut into chunks and compared chunk by chunk.
SET_BYTES = 8 << 20


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles of ``text``, repeats included, as uint64.

    A-Z are lower-cased, words are runs of anything but ASCII white space. Fewer words
    than a shingle hash as one sequence; none give no hash.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.array([digest(joined[i : j - 1], SEED) for i, j in zip(starts, starts[shingle:])], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in more than half of the hashes; no hashes give 0."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _COLUMNS).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (2 * counts.ravel() > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other 64-bit hashes made of ``hashes``, independent of them and of those of other turns."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of ``text``; no words give 0."""
    return majority(shingle_hashes(text, shingle))


def wide_fingerprint(hashes: np.ndarray, words: int = 8) -> bytes:
    """``words`` times 64 bits of SimHash of shingle hashes; none give zeros."""
    return b"".join(majority(mixed(hashes, i)).to_bytes(8, "little") for i in range(words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp bigint): one row for each row of ``docs``; a null text counts as empty."""

    def rows(x: dict[str, list]) -> dict[str, list]:
        return {"doc_id": x["doc_id"], "fp": np.array([fingerprint(t, shingle) for t in x["text"]], dtype=np.uint64).view(np.int64)}

    return arrow_map(texts(docs, id_col, text_col), rows, "doc_id bigint, fp bigint")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """(doc_id, row, digest, fp, n_shingles): for each row of ``docs`` the hash of its text, and digest, SimHash and size of its set of shingles."""

    def rows(x: dict[str, list]) -> dict[str, list]:
        sets = [np.unique(shingle_hashes(t, shingle)) for t in x["text"]]
        return {"doc_id": x["doc_id"], "row": x["row"], "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "fp": [wide_fingerprint(s, words) for s in sets], "n_shingles": [len(s) for s in sets]}

    own = texts(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    return arrow_map(own, rows, "doc_id bigint, row bigint, digest binary, fp binary, n_shingles bigint")


def block_masks(distance: int, shared: int = 3) -> list[int]:
    """Masks of which any two fingerprints within ``distance`` agree on at least one.

    The bits are cut into ``distance + shared`` blocks; at most ``distance`` of them hold
    a differing bit, so at least ``shared`` are equal, and each choice of that many is a mask.
    """
    n = distance + shared
    edges = [i * BITS // n for i in range(n + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    return [sum(c) for c in combinations(blocks, shared)]


def in_blocks(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(m, k, fp): each fingerprint (fp bigint) in the bucket k of every mask m of ``block_masks``."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(distance)]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("smallint").alias("m"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("k")) for i, m in enumerate(signed)])).alias("x"))
    return keyed.select("x.m", "x.k", "fp")


def bit_difference(similarity: float) -> float:
    """Expected share of differing bits of two texts of one length at a Jaccard ``similarity`` of their shingles."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def split_count(similarity: float, recall: float, bits: int, block_bits: int) -> int:
    """Random splits of ``bits`` into blocks after which a pair shares one with probability ``recall``."""
    shared = (1 - bit_difference(similarity)) ** block_bits
    return math.ceil(math.log(1 - recall) / math.log(1 - shared) / (bits // block_bits))


def in_split_blocks(fps: DataFrame, words: int, block_bits: int, splits: int, seed: int = 11) -> DataFrame:
    """(m, k, fp): each fingerprint (fp binary) in the bucket of each of its blocks, for several random splits; of itself it brings SHORT bytes."""
    rng, bits = np.random.default_rng(seed), BITS * words
    weights = np.zeros((bits, splits * (bits // block_bits)))
    for s in range(splits):
        order = rng.permutation(bits)
        for b in range(bits // block_bits):
            weights[order[b * block_bits : (b + 1) * block_bits], s * (bits // block_bits) + b] = 2.0 ** np.arange(block_bits)
    count = weights.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                own = batch.column(0).slice(i, 1000)
                each = np.unpackbits(np.frombuffer(b"".join(own.to_pylist()), dtype=np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
                keys = (each.astype(np.float64) @ weights).astype(np.int64).ravel()
                short = pa.array([x[:SHORT] for x in own.to_pylist()], pa.binary()).take(pa.array(np.repeat(np.arange(len(own)), count)))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(count, dtype=np.int16), len(own))), pa.array(keys), short], names=["m", "k", "fp"])

    return fps.select("fp").mapInArrow(run, "m smallint, k bigint, fp binary")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, one uint64 or a row of them each."""
    x = np.bitwise_count(a ^ b)
    return x if x.ndim == 1 else x.sum(axis=1, dtype=np.int64)


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest, as index pairs, of the graph of all pairs of ``fps`` within ``distance``.

    Breadth-first over what is not reached yet: a tight group costs one pass, and no
    more than ``len(fps) - 1`` links come out of it.
    """
    left, links = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = hamming(fps[left], fps[at]) <= distance
            if near.any():
                found = left[near]
                links += [(int(at), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return links


def in_tiles(keyed: DataFrame, distinct: int) -> DataFrame:
    """(m, k, tile, fp): rows of a bucket above CHUNK go to the tiles that pair their chunk with every chunk.

    Any two rows of a bucket meet in a tile, and a tile holds two chunks. With no more
    than CHUNK distinct fingerprints in all there is no such bucket to look for.
    """
    plain = keyed.select("m", "k", F.lit(0).cast("bigint").alias("tile"), "fp")
    if distinct <= CHUNK:
        return plain
    hot = stored(keyed.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK))
    if hot.isEmpty():
        return plain
    chunks = F.ceil(F.col("n") / CHUNK).cast("bigint")
    both = keyed.join(small(hot), ["m", "k"], "left").withColumn("chunks", F.coalesce(chunks, F.lit(1)))
    own = both.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    tile = lambda other: F.least("chunk", other) * F.col("chunks") + F.greatest("chunk", other)
    return own.select("m", "k", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1), tile)).alias("tile"), "fp")


def links(keyed: DataFrame, distance: int) -> DataFrame:
    """(a, b): links within ``distance`` that connect what all such links of a bucket connect.

    ``keyed`` has rows (m, k, tile, fp) of distinct fingerprints, bigint or binary. Tiles of
    buckets are hash-partitioned, sorted by Spark (which spills) and streamed, so a task
    holds one tile of fingerprints at a time.
    """
    kind = keyed.schema["fp"].dataType.simpleString()
    dealt = keyed.repartition("m", "k", "tile").sortWithinPartitions("m", "k", "tile")

    def numbers(fp: pa.Array) -> np.ndarray:
        if kind == "bigint":
            return fp.to_numpy(zero_copy_only=False).view(np.uint64)
        return np.frombuffer(b"".join(fp.to_pylist()), dtype="<u8").reshape(len(fp), -1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _ended(batches):
            if batch is not None:
                parts = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "k", "tile")), numbers(batch.column(3))]
                rest = parts if rest is None else [np.concatenate([r, x]) for r, x in zip(rest, parts)]
            if rest is None:
                return
            m, k, tile, fp = rest
            new = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1]) | (tile[1:] != tile[:-1])) + 1
            cuts = np.concatenate([[0], new, [len(m)] if batch is None else []]).astype(np.int64)
            rest = [x[cuts[-1] :] for x in rest]
            a, b = [], []
            for i in np.flatnonzero(np.diff(cuts) > 1):
                group = fp[cuts[i] : cuts[i + 1]]
                for x, y in forest(group, distance):
                    a.append(group[x])
                    b.append(group[y])
            if a:
                pairs = (pa.array(np.array(e).view(np.int64)) if kind == "bigint" else pa.array([x.tobytes() for x in e], pa.binary()) for e in (a, b))
                yield pa.RecordBatch.from_arrays(list(pairs), names=["a", "b"])

    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def _ended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _groups(own: DataFrame, keyed: Callable[[DataFrame], DataFrame], distance: int) -> DataFrame:
    """(doc_id, fp, component_id) of (doc_id, fp) rows, links made in the buckets that ``keyed`` gives.

    Copies meet once as a distinct fingerprint before any comparison. Only fingerprints
    that are linked get another id than their own least one, and rows of hot fingerprints
    are not dealt by fingerprint.
    """
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(links(in_tiles(keyed(distinct.select("fp")), distinct.count()), distance))
    linked = stored(distinct.join(small(roots.withColumnRenamed("node", "fp")), "fp"))
    least = stored(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    moved = stored(linked.join(small(least), "root").select("fp", F.col("component_id").alias("moved")))
    of = stored(distinct.join(small(moved), "fp", "left").select("fp", F.coalesce("moved", "first").alias("component_id")))
    return joined_by(own, of, "fp", distinct).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of ``docs``.

    Fingerprints within ``distance`` bits are linked; component_id is the least doc_id
    that links reach, the document's own included. Documents without words have
    fingerprint zero and link like any other. A null doc_id is kept and never chosen as
    component_id unless its whole component has no other. An empty table gives no rows.
    """
    own = stored(fingerprints(docs, id_col, text_col, shingle))
    groups = _groups(own, lambda fps: in_blocks(fps, distance), distance)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def most_bits(bits: int, similarity: float, deviations: float) -> int:
    """The number of differing bits that is expected at ``similarity``, and so many standard deviations more."""
    share = bit_difference(similarity)
    return int(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def similar_pairs(fps: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Index pairs that connect what all pairs of ``sets`` (sorted hashes) at ``similarity`` or more connect.

    Each pair that is given is at ``similarity`` by its sets themselves. Sizes and
    fingerprints only spare comparisons: four standard deviations are allowed.
    """
    most, sizes = most_bits(8 * SHORT, similarity, 4), np.array([len(x) for x in sets])
    left, pairs = np.arange(len(sets)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            may = (hamming(fps[left], fps[at]) <= most) & (np.minimum(sizes[left], sizes[at]) >= similarity * np.maximum(sizes[left], sizes[at]) - 1e-9)
            met = np.zeros(len(left), dtype=bool)
            for i in np.flatnonzero(may).tolist():
                shared = len(np.intersect1d(sets[at], sets[left[i]], assume_unique=True))
                met[i] = shared >= similarity * (sizes[at] + sizes[left[i]] - shared) - 1e-9
            found = left[met]
            pairs += [(int(at), int(x)) for x in found]
            queue += list(found)
            left = left[~met]
    return pairs


def verified_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): digests of shingle sets at ``similarity`` or more that connect what all such pairs of a group connect.

    ``members`` has rows (grp, tile, digest, fp, shingles). A tile is sorted by Spark and
    streamed, so a task holds one at a time.
    """
    dealt = members.select("grp", "tile", "digest", "fp", "shingles").repartition("grp", "tile").sortWithinPartitions("grp", "tile")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in _ended(part for whole in batches for part in sliced(whole)):
            rest += [] if batch is None else [batch]
            if not rest:
                return
            ends = [tuple(b.column(c)[i].as_py() for c in (0, 1)) for b, i in ((rest[0], 0), (rest[-1], rest[-1].num_rows - 1))]
            if batch is not None and ends[0] == ends[1]:
                continue
            whole = pa.Table.from_batches(rest)
            group, tile = whole["grp"].to_numpy(), whole["tile"].to_numpy()
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (tile[1:] != tile[:-1])) + 1).tolist(), *([len(group)] if batch is None else [])]
            links = []
            for i, j in zip(cuts, cuts[1:]):
                own = whole.slice(i, j - i).to_pydict()
                alone = dict(zip(own["digest"], zip(own["fp"], own["shingles"])))
                digests = list(alone)
                fps = np.frombuffer(b"".join(x for x, _ in alone.values()), dtype="<u8").reshape(len(alone), -1)
                links += [(digests[x], digests[y]) for x, y in similar_pairs(fps, [np.frombuffer(x, dtype=np.uint64) for _, x in alone.values()], similarity)]
            rest = whole.slice(cuts[-1]).combine_chunks().to_batches()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*links)], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.97, words: int = 8) -> DataFrame:
    """(doc_id, component_id): a row for each row of ``docs``, groups of texts alike in ``similarity`` of their shingles.

    Similarity is that of shingle sets (Jaccard). Candidates share a block of ``words`` * 64
    bits of SimHash: the bits are split at random into blocks as wide as the logarithm of
    the number of different sets, so a bucket holds about one set that is unlike, as often
    as a pair at ``similarity`` needs to share a block with probability ``recall``; closer
    pairs do with more. In a bucket, fingerprints link at the distance expected at ``similarity`` and two and a half
    standard deviations more. What such links connect is a group, whose shingle sets meet
    in a task, or in tiles of bounded size, and every link is a pair whose sets are
    compared. component_id is the least doc_id that verified links reach.

    Equal shingle sets meet once. Texts without words are one group; a text of fewer words
    than a shingle is one shingle. A null doc_id is kept and never chosen unless its whole
    group has no other; an empty table gives no rows. A text's shingles are all in memory of
    the task that reads it, 8 bytes a word.
    """
    with scratch(docs.sparkSession), cleaned_shuffles(docs.sparkSession):
        own = stored(shingle_sets(docs, id_col, text_col, shingle, words))
        place = F.struct(F.col("doc_id").isNull().alias("odd"), "doc_id", "row")
        distinct = stored(own.groupBy("digest", "fp", "n_shingles").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).select("digest", "fp", F.substring("fp", 1, SHORT).alias("short"), "n_shingles", F.col("first.doc_id").alias("first"), F.col("first.row").alias("row"), "n"))
        n = distinct.count()
        width = max(12, math.ceil(math.log2(n + 1)))
        keyed = in_split_blocks(distinct.dropDuplicates(["short"]), words, width, split_count(similarity, recall, BITS * words, width))
        loose = connected_components(links(in_tiles(keyed, n), most_bits(8 * SHORT, similarity, 2.5)))
        grouped = stored(distinct.join(small(stored(loose.withColumnRenamed("node", "short"))), "short", "left").withColumn("grp", F.xxhash64(F.coalesce("root", "short"))).drop("root", "fp"))
        sizes = stored(grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("size")).where("sets > 1"))
        chunks = F.ceil(F.col("size") * 8 / F.lit(SET_BYTES)).cast("bigint")
        wanted = stored(grouped.join(small(sizes), "grp").select(F.col("first").alias("own_id"), F.col("row").alias("own_row"), "digest", "short", "grp", F.greatest(chunks, F.lit(1)).alias("chunks")))
        members = _with_sets(docs, wanted, id_col, text_col, shingle)
        chunk = F.pmod(F.xxhash64("digest"), F.col("chunks"))
        tile = lambda other: F.least(chunk, other) * F.col("chunks") + F.greatest(chunk, other)
        tiled = members.withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1), tile)))
        roots = connected_components(stored(verified_links(tiled, similarity)))
        linked = stored(distinct.select("digest", "first").join(small(stored(roots.withColumnRenamed("node", "digest"))), "digest"))
        least = stored(linked.groupBy("root").agg(F.min("first").alias("component_id")))
        moved = stored(linked.join(small(least), "root").select("digest", F.col("component_id").alias("moved")))
        of = stored(distinct.select("digest", "first").join(small(moved), "digest", "left").select("digest", F.coalesce("moved", "first").alias("component_id")))
        return stored(joined_by(own.select("doc_id", "digest"), of, "digest", distinct.select("digest", "n")).select("doc_id", "component_id"), keep=True)


def _with_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(grp, chunks, digest, fp, shingles): the shingle sets of the texts that stand for ``wanted`` (own_id, own_row, digest, short, grp, chunks)."""
    own = texts(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    found = own.join(small(wanted, "shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row") == F.col("own_row")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in sliced(batch):
                digests, sets = part.column("digest").to_pylist(), []
                new = [i for i, d in enumerate(digests) if d not in seen and not seen.add(d)]
                at = pa.array(new, pa.int64())
                for t in part.column("text").take(at).to_pylist():
                    sets.append(np.unique(shingle_hashes(t, shingle)).tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("grp", "chunks", "digest", "short")), pa.array(sets, pa.binary())], names=["grp", "chunks", "digest", "fp", "shingles"])

    return found.select("grp", "chunks", "digest", "short", "text").mapInArrow(run, "grp bigint, chunks bigint, digest binary, fp binary, shingles binary")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stand for their group of ``similar_documents``, with all their columns as they are.

    Of each component the rows with its least id stay; rows with a null id have no id
    to compare and stay too. Rows that share the least id all stay.
    """
    groups, name = similar_documents(docs, id_col, text_col, shingle, similarity), free_name(docs, "first")
    first = groups.where("doc_id = component_id").select(F.col("component_id").alias(name)).distinct()
    key = col(id_col).cast("bigint")
    kept = docs.join(first.hint("shuffle_hash"), key == col(name), "left_semi")
    return kept.unionByName(docs.where(key.isNull()))
