"""Target-distribution importance resampling over hashed word n-grams.

Every n-gram falls into a bucket by its hash; a bucket's gain is the log ratio of its
smoothed shares in the target and in the corpus. A document weighs the sum of its
n-grams' gains, and those with the greatest weight plus Gumbel noise are drawn.

A text longer than a chunk is cut at word boundaries. A chunk owns the n-grams that start
in it and carries the n - 1 words that follow, so those that cross a cut are counted once.
Chunks are dealt over the tasks; counts and weights are summed by document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import global_row_number
from .common import scratch, sliced, stored, texts

#: Bytes of a chunk; longer texts are cut.
CHUNK = 1 << 16
#: Hashes of short words that a task keeps.
MOST_WORDS = 500_000

#: Bytes that are no letter, digit or part of another character become spaces; A-Z become a-z.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


_WORD = re.compile(rb"[^ ]+")


class Hashed(dict):
    """Word -> bucket, kept for words that come again."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        made = zlib.crc32(word) % self.buckets
        if len(word) <= 32:
            self[word] = made
        return made

    def of(self, own: bytes, carry: bytes, n: int) -> tuple[int, np.ndarray]:
        """(words, buckets of the n-grams of 1 to n words) that start in ``own``."""
        if len(self) > MOST_WORDS:
            self.clear()
        words = own.split()
        found = [np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))]
        if n > 1:
            after = words + carry.split()[: n - 1]
            for size in range(2, n + 1):
                grams = (b" ".join(after[i : i + size]) for i in range(min(len(words), len(after) - size + 1)))
                found.append(np.array([zlib.crc32(g) % self.buckets for g in grams], dtype=np.int64))
        return len(words), np.concatenate(found)


def following(folded: bytes, at: int, n: int) -> bytes:
    """The first ``n`` words behind ``at``, joined by spaces."""
    found = []
    while len(found) < n and (m := _WORD.search(folded, at)):
        found.append(m.group())
        at = m.end()
    return b" ".join(found)


def pieces(folded: bytes, size: int, n: int) -> Iterator[tuple[bytes, bytes]]:
    """(own, carry): chunks of about ``size`` bytes that end at a word's end, each with the n - 1 words after it."""
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end], following(folded, end, n - 1)
        at = end


def chunked(rows: DataFrame, n: int, size: int) -> DataFrame:
    """(doc_id, row, piece, own binary, carry binary): folded texts, those above ``size`` bytes in chunks dealt over the tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                for i, body in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    made, at = [], 0
                    for own, carry in pieces(body.translate(FOLDED), size, n):
                        made.append((own, carry))
                        if len(made) * size >= 8 << 20:
                            yield _rows(part, i, at, made)
                            made, at = [], at + len(made)
                    if made or not at:
                        yield _rows(part, i, at, made or [(b"", b"")])

    schema = "doc_id bigint, row bigint, piece bigint, own binary, carry binary"
    short = rows.where(F.octet_length("text") <= size)
    long = rows.where(F.octet_length("text") > size).mapInArrow(run, schema)
    plain = short.select("doc_id", "row", F.lit(0).cast("bigint").alias("piece"), F.encode("text", "utf-8").alias("own"), F.lit(b"").alias("carry"))
    return plain.unionByName(long.repartition("row", "piece"))


def _rows(part: pa.RecordBatch, i: int, at: int, made: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    same = pa.array([i] * len(made))
    columns = [part.column("doc_id").take(same), part.column("row").take(same), pa.array(range(at, at + len(made)), pa.int64()), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "piece", "own", "carry"])


def bucket_counts(rows: DataFrame, n: int, buckets: int, size: int = CHUNK) -> DataFrame:
    """(bucket, n): n-grams of all texts of ``rows`` (doc_id, row, text) by bucket; a task sends a row a bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashed = np.zeros(buckets, dtype=np.int64), Hashed(buckets)
        for batch in batches:
            for part in sliced(batch):
                both = zip(part.column("own").to_pylist(), part.column("carry").to_pylist())
                total += np.bincount(np.concatenate([hashed.of(own.translate(FOLDED), carry, n)[1] for own, carry in both]), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return chunked(rows, n, size).select("own", "carry").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """A bucket's floor(1000 * ln) of its smoothed share in the target over that in the corpus; ``buckets`` rows of each come here."""
    s, t = ({r["bucket"]: r["n"] for r in counts.collect()} for counts in (corpus, target))
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    share = lambda b: float(t.get(b, 0) + 1) * all_s / (float(s.get(b, 0) + 1) * all_t)
    return [math.floor(1000 * math.log(share(b))) for b in range(buckets)]


def weights(rows: DataFrame, gain: list[int], n: int, size: int = CHUNK) -> DataFrame:
    """(doc_id, row, n_words, n_features, weight): a row for each of ``rows`` (doc_id, row, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gained, hashed = np.array(gain, dtype=np.int64), Hashed(len(gain))
        for batch in batches:
            for part in sliced(batch):
                made = []
                for own, carry in zip(part.column("own").to_pylist(), part.column("carry").to_pylist()):
                    words, found = hashed.of(own.translate(FOLDED), carry, n)
                    made.append((words, len(found), int(gained[found].sum())))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "row", "piece")), *(pa.array(x, pa.int64()) for x in zip(*made))], names=["doc_id", "row", "piece", "n_words", "n_features", "weight"])

    each = stored(chunked(rows, n, size).mapInArrow(run, "doc_id bigint, row bigint, piece bigint, n_words bigint, n_features bigint, weight bigint"))
    long = stored(each.where("piece > 0").select("doc_id", "row").distinct())
    same = each["doc_id"].eqNullSafe(long["doc_id"]) & (each["row"] == long["row"])
    copies = F.sum((F.col("piece") == 0).cast("bigint"))
    names = ("n_words", "n_features", "weight")
    summed = each.join(long, same, "left_semi").groupBy("doc_id", "row").agg(copies.alias("copies"), *[F.sum(c).alias(c) for c in names])
    repeated = summed.select("doc_id", "row", *[F.expr(f"{c} div copies").alias(c) for c in names], F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col")
    return each.join(long, same, "left_anti").select("doc_id", "row", *names).unionByName(repeated)


def gumbel(h: Column) -> Column:
    """floor(1000 times the Gumbel noise) of an unsigned 32-bit integer."""
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024", size: int = CHUNK) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): a row for each row of ``docs``; rank is null for those that are not drawn.

    Features are the runs of 1 to ``n`` words, repeats counted. Of the documents of
    ``least_words`` words or more, ``percent`` % with the greatest scores are drawn, rank 1
    first; ties go to the smaller doc_id, null ones last, then to the text's hash. The
    noise comes from the sha256 of seed:doc_id, of no digits for a null id. A null text has
    no words; repeated rows repeat; an empty table gives no rows, and an empty target
    smoothed shares. All texts are counted whole; a chunk is all of a long text that a task
    holds at a time after it is cut.
    """
    own = texts(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("row"))
    wanted = target.select(F.lit(0).cast("bigint").alias("doc_id"), F.coalesce(F.col("`" + target_col.replace("`", "``") + "`"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    with scratch(docs.sparkSession):
        gain = gains(bucket_counts(own, n, buckets, size), bucket_counts(wanted, n, buckets, size), buckets)
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        scored = stored(weights(own, gain, n, size).withColumn("score", F.col("weight") + gumbel(h)), keep=True)
    drawn = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    order = scored.select("*", (F.col("n_words") < least_words).alias("short"), (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("odd"))
    ranked = global_row_number(order, "short", "down", "odd", "doc_id", "row", name="place")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).cast("bigint").alias("rank"))
