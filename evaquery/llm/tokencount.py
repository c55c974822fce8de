"""Token counts behind a digest cache.

A count depends on a text and a tokenizer only, so it is stored under the digest of
both. Documents are reduced to digests first; only digests that the cache lacks are
encoded, one text each, and appended to it.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import SPACED, Cached, library_pieces, library_tokenizer
from .common import BROADCAST_ROWS, arrow_map, exists, joined_by, shared_dir, stored, texts

#: A corpus of which the cache lacks more than one digest in so many is a new one.
NEW_SHARE = 50
STORED = "content binary, n_tokens bigint, tokenizer string"


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer version: the file's bytes and the version of the library that reads it."""
    import importlib.metadata

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode() + f.read()).hexdigest()


@cache
def _counter(path: str):
    """Texts -> numbers of tokens; one tokenizer and one cache of pieces a worker."""
    if path.endswith(".model"):
        library = library_pieces(path)
        return lambda texts_: [len(library.encode(t)) for t in texts_]
    library = library_tokenizer(path)
    cached = Cached(lambda pieces: [len(e) for e in library.encode_batch_fast(pieces, add_special_tokens=False)])
    return lambda texts_: list(map(sum, cached.values(list(map(SPACED.findall, texts_)))))


def counted(texts_: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens), once for each content of (content, text) rows."""

    def rows(x: dict[str, list]) -> dict[str, list]:
        once = dict(zip(x["content"], x["text"]))
        return {"content": list(once), "n_tokens": _counter(path)(list(once.values()))}

    each = arrow_map(texts_.select("content", "text"), rows, "content binary, n_tokens bigint")
    return each.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # repeated rows share doc_id and content


def cached_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """(content, n_tokens) that the cache at ``cache_path`` holds for a tokenizer version."""
    if not exists(spark, cache_path):
        return spark.createDataFrame([], "content binary, n_tokens bigint")
    held = spark.read.schema(STORED).parquet(cache_path).where(F.col("tokenizer") == version)
    return held.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # writers that ran at once may both have stored one


def token_counts(docs: DataFrame, tokenizer: str, limit: int, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each row of ``docs``.

    ``tokenizer`` is a .json file for the tokenizers library or a .model file for
    sentencepiece; the count is the library's for the whole text, however long, no begin,
    end or special tokens added, over_limit is n_tokens > limit. Content is normalised only
    as far as no count can change: a null text counts as empty. ``cache_path`` is a Parquet
    folder that outlives the call (None: one of its own). Copies, of one document or of
    a third of all rows, meet as one digest; of each missing digest the text of its least
    doc_id is encoded. Texts stay where they are read if the cache lacks few digests, at
    most one in NEW_SHARE, which go to them; the texts of a new corpus are dealt to the
    tasks that encode them. A null doc_id stays null, repeated rows repeat,
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    cache_path = cache_path or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    own = texts(docs, id_col, text_col).withColumn("content", F.unhex(F.sha2("text", 256)))
    thin = stored(own.select("doc_id", "content", F.octet_length("text").cast("bigint").alias("n_bytes")))
    distinct = stored(thin.groupBy("content").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    missing = stored(distinct.join(cached_counts(spark, cache_path, version), "content", "left_anti").select(F.col("content").alias("c"), "rep"))
    if not missing.isEmpty():
        n = missing.count()
        warm = n * NEW_SHARE <= distinct.count() and n <= BROADCAST_ROWS
        wanted = F.broadcast(missing) if warm else missing.hint("shuffle_hash")
        found = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("content") == F.col("c")), "left_semi")
        counted(found, tokenizer).withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = stored(cached_counts(spark, cache_path, version))
    return joined_by(thin, counts, "content", distinct).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
