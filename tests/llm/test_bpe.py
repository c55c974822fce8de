import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from evaquery.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
MULTI = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "a", "  two  spaces\n\n and \t tabs ", "x\x1cy\x1d z \x85 \xa0b", "don't we'll I'D", "<|endoftext|>", "日本語 テスト", "a" * 300, "12 345²½ !!! ??", "᠎ x ​ y", "😀👍🏽", "é", "end \n", "ÀÖØÞß ÿµª× ÷", " em space  ", "\r\n\r\n x"]


def library(path):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})


def odd_texts():
    rnd = random.Random(5)
    return ODD + [rnd.choice(["", " "]).join(rnd.choice(ODD + ["the", "Queue", "ñandú"]) for _ in range(rnd.randint(1, 8))) for _ in range(150)]


@pytest.mark.parametrize("path", [PATH, MULTI])
def test_codec_matches_the_library(path):
    own, lib = bpe.Codec(path, P.PATTERN), library(path)
    texts = odd_texts()
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == lib.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_long_words():
    rank, lib = bpe.ranks(PATH), library(PATH)
    rnd = random.Random(1)
    for n in (49, 60, 500, 20000):
        for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "é"):
            word = "".join(rnd.choice(alphabet) for _ in range(n))
            assert bpe.folded(word.encode(), rank) == lib.encode_ordinary(word)


def test_spark_functions_give_the_same(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:60])]
    got = bpe.spark_encoded(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, P.PATTERN)
    got = got.select("doc_id", "ids", bpe.spark_decoded(F.col("ids"), PATH).alias("back")).collect()
    lib = library(PATH)
    for r in got:
        assert r.ids == lib.encode_ordinary(rows[r.doc_id][1])
        assert bytes(r.back) == rows[r.doc_id][1].encode()
    plan = bpe.spark_encoded(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PATH, P.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapInArrow" not in plan  # the vocabulary itself holds the word Python


def test_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "no id"), (3, "w " * 40000), (4, "x" * 30000)] + [(10 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, ids int")
    lib, sha = library(PATH), lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := lib.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows]
    assert sorted(map(tuple, bpe.round_trip(df, PATH, P.PATTERN).collect()), key=str) == sorted(want, key=str)
    assert bpe.encoded(df, PATH, P.PATTERN).where("size(ids) > 0").count() == len([t for _, t in rows if t])
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0


def test_distinct_words_folded_in_spark_give_the_same(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:60])] + [(3, ODD[3]), (None, "no id the the")]
    got = bpe.spark_encoded_words(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, P.PATTERN).collect()
    lib = library(PATH)
    assert sorted([(r.doc_id, r.ids) for r in got], key=str) == sorted([(i, lib.encode_ordinary(t)) for i, t in rows], key=str)
