"""Byte-level BPE encoding and decoding by a rank file.

Text is split by the tokenizer's pattern. A word is an array of one-byte pieces; a fold
merges the adjacent pair of least rank, leftmost first, until no pair has a rank.
Decoding puts the binary pieces of the ids end to end.

The fold exists twice. ``spark_encoded`` is Spark's own higher-order functions over a
literal rank map, and gives every result; measured, it needs several times the CPU that
is allowed (see the README), so ``encoded`` folds the same way in Arrow batches: each
distinct word of a batch once, with a bounded cache of words between batches.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterable
from functools import cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import Cached
from .common import arrow_map, joined_by, stored, texts

BUCKETS = 1 << 15
SLICE_BYTES = 6 << 20
#: The split of the public byte-level vocabularies, and the same within Latin-1,
#: where letters, numbers and white space can be listed.
UNICODE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _literal_map(entries: dict[str, object], kind: str) -> Column:
    """A literal array of small maps; an entry lies in the bucket of its key's crc32."""
    buckets: list[dict[str, object]] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = value
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), f"array<map<string,{kind}>>")


def _found(table: Column, key: Column) -> Column:
    return F.try_element_at(F.get(table, F.pmod(F.crc32(key), F.lit(BUCKETS)).cast("int")), key)


def _once(value: Column, use) -> Column:
    """``use(value)``, the value computed, and written into the plan, once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column, pattern: str) -> Column:
    """The pattern's matches, with Unicode white space as the tokenizers take it."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


def _as_bytes(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _merged(table: Column, pieces: Column) -> Column:
    """The pieces of one word after all merges."""
    first = F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), lambda i: _found(table, F.concat(F.get(pieces, i), F.get(pieces, i + 1))))
    start = F.struct(pieces.alias("p"), first.alias("r"))
    none = F.array().cast("array<int>")

    def merge(acc: Column, k: Column) -> Column:
        p, r = acc["p"], acc["r"]
        new = F.concat(F.get(p, k - 1), F.get(p, k))
        before = F.when(k > 1, F.array(_found(table, F.concat(F.get(p, k - 2), new)))).otherwise(none)
        after = F.when(k < F.size(r), F.array(_found(table, F.concat(new, F.get(p, k + 1))))).otherwise(none)
        rest = lambda x, n: F.slice(x, n, F.size(x))
        return F.struct(
            F.concat(F.slice(p, F.lit(1), k - 1), F.array(new), rest(p, k + 2)).alias("p"),
            F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), before, after, rest(r, k + 2)).alias("r"),
        )

    def step(acc: Column, _: Column) -> Column:
        least = F.array_position(acc["r"], F.array_min(acc["r"])).cast("int")
        return _once(least, lambda k: F.when(k.isNull(), acc).otherwise(merge(acc, k)))

    return F.aggregate(F.sequence(F.lit(1), F.size(pieces) - 1), start, step, lambda acc: acc["p"])


def _folded(table: Column, word: Column) -> Column:
    """Ids of one word, by its own rank or by merging."""

    def parts(latin: Column) -> Column:
        whole = _found(table, latin)
        merged = _once(F.split(latin, ""), lambda p: _merged(table, p))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(merged, lambda p: _found(table, p)))

    return _once(_as_bytes(word), parts)


def spark_encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of (doc_id, text) rows, in Spark's functions alone.

    Ranks are a literal map, cut into buckets by the crc32 of the key because Spark
    searches a map from its start. Bytes are written as Latin-1 characters, one for
    each, so pieces concatenate as strings.
    """
    table = _literal_map({k.decode("latin-1"): v for k, v in ranks(path).items()}, "int")
    ids = _once(table, lambda t: F.flatten(F.transform(words_of(F.col("text"), pattern), lambda w: _folded(t, w))))
    return docs.select("doc_id", ids.alias("ids"))


def spark_encoded_words(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``spark_encoded``, each distinct word of all texts folded once and joined back to its occurrences."""
    table = _literal_map({k.decode("latin-1"): v for k, v in ranks(path).items()}, "int")
    rows = stored(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    found = stored(rows.select("row", F.posexplode(words_of(F.col("text"), pattern)).alias("pos", "word")))
    sizes = stored(found.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    words = stored(sizes.select("word", _once(table, lambda t: _folded(t, F.col("word"))).alias("part")))
    parts = joined_by(found, words, "word", sizes).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    ids = F.coalesce(F.flatten(F.transform("parts", lambda p: p["part"])), F.array().cast("array<int>"))
    return rows.join(parts, "row", "left").select("doc_id", ids.alias("ids"))


def spark_decoded(ids: Column, path: str) -> Column:
    """The bytes of an array of ids, in Spark's functions alone. An unknown id gives null."""
    listed = sorted((v, k.decode("latin-1")) for k, v in ranks(path).items())
    table = [None] * (listed[-1][0] + 1)
    for v, k in listed:
        table[v] = k
    pieces = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "array<string>")
    made = _once(pieces, lambda t: F.transform(ids, lambda i: F.get(t, i)))
    return F.when(~F.exists(made, lambda p: p.isNull()), F.encode(F.array_join(made, ""), "ISO-8859-1"))


def folded(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one word: its own, or those of its pieces after all merges.

    Short words look all pairs over for each merge; in longer ones a heap holds the
    pairs, so a word of n bytes takes time in n log n.
    """
    whole = rank.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 48:
        return _folded_long(word, rank)
    pieces = [word[i : i + 1] for i in range(len(word))]
    get, none = rank.get, len(rank) + 1
    pairs = [get(a + b, none) for a, b in zip(pieces, pieces[1:])]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(pieces[i - 1] + pieces[i], none)
        if i < len(pairs):
            pairs[i] = get(pieces[i] + pieces[i + 1], none)
    return [rank[p] for p in pieces]


def _folded_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        end[i], after[i], alive[j] = stop, after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (r := rank.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := rank.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [rank[word[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """A rank file and a pattern at work in one worker."""

    def __init__(self, path: str, pattern: str) -> None:
        self.rank = ranks(path)
        self.piece = {v: k for k, v in self.rank.items()}
        self.decimal = {v: str(v) for v in self.piece}
        self.split = regex.compile(pattern)
        self.narrow = re.compile(LATIN_PATTERN) if pattern == UNICODE_PATTERN else None
        self.kind = "H" if max(self.piece) < 1 << 16 else "I"
        self.words = Cached(lambda ws: [array(self.kind, folded(w.encode("utf-8", "surrogatepass"), self.rank)).tobytes() for w in ws])

    def _split(self, text: str) -> list[str]:
        if self.narrow:
            try:
                text.encode("latin-1")
                return self.narrow.findall(text)
            except UnicodeEncodeError:
                pass
        return self.split.findall(text)

    def encode(self, texts_: list[str]) -> list[array]:
        lists = list(map(self._split, texts_))
        words = pa.array(chain.from_iterable(lists), pa.string(), size=sum(map(len, lists))).dictionary_encode()
        values = self.words.distinct(words.dictionary.to_pylist())
        at = iter(map(values.__getitem__, words.indices.to_pylist()))
        out = []
        for one in lists:
            ids = array(self.kind)
            ids.frombytes(b"".join(islice(at, len(one))))
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))

    def text_of(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec, and its cache of words, a worker."""
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of each row's whole text, without special tokens; none of a null one."""

    def rows(x: dict[str, list]) -> dict[str, list]:
        return {"doc_id": x["doc_id"], "ids": [ids.tolist() for ids in codec(path, pattern).encode(x["text"])]}

    return arrow_map(texts(docs, id_col, text_col), rows, "doc_id bigint, ids array<int>", SLICE_BYTES)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): one row for each row of ``docs``.

    The ids are those of the rank file's tokenizer for the whole text, without special
    tokens; their digest is of the decimal ids joined by one space, the other one of the
    bytes that the ids decode to. A null text counts as empty: no ids, digests of
    nothing. Repeated rows repeat; an empty table gives no rows; nothing is shuffled.
    """

    def rows(x: dict[str, list]) -> dict[str, list]:
        own, digest = codec(path, pattern), lambda data: hashlib.sha256(data).hexdigest()
        out = {"doc_id": x["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in own.encode(x["text"]):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(digest(own.text_of(ids).encode()))
            out["decoded_sha256"].append(digest(own.decode(ids)))
        return out

    return arrow_map(texts(docs, id_col, text_col), rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", SLICE_BYTES)
