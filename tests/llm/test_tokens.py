import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evaquery.llm import chunks, common, pfor, tokencount

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "a", "  two  spaces\n\n and \t tabs ", "x\x1cy\x1d z", "foo bar baz　", "don't we'll", "<|endoftext|> mid<|endoftext|>dle <|startoftext|>", "é é ́x", "日本語 テスト", "a" * 5000, "12 345 !!! ??", "᠎ x ​ y", "İstanbul ΣΑΣ ς", "end \n", "ÀÖØÞß ÿµª² x³ ½!¿«»", "a\u0085b\xa0c ÉÈ", "A\x00B\x7f__C_", "A1b2, C-D. É!é"]


def odd_texts():
    rnd = random.Random(2)
    parts = ODD + ["the", "Queue", "ñandú", "\n", "\u0085", "'s", "\r\n", "😀👍🏽"]
    return ODD + [rnd.choice(["", " "]).join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(300)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_encode_as_the_library_does(path):
    library = Tokenizer.from_file(path)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert pfor.encoded([text], path)[0].tolist() == want, text
        assert tokencount._counter(path)([text]) == [len(want)]


def test_cache_keeps_values_when_it_turns_over():
    calls = []
    cached = chunks.Cached(lambda ps: [calls.append(p) or len(p) for p in ps], most=10)
    for _ in range(3):
        for n in range(1, 30):
            assert cached.values([["x" * n, "y"], [], ["x" * n]]) == [[n, 1], [], [n]]
    assert cached.distinct(["q", "y", "x"]) == [1, 1, 1] and cached.distinct([]) == []
    assert len(cached.young) <= 10 and calls.count("y") == 1


@pytest.mark.parametrize("seed", range(12))
def test_shard_round_trip(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 400, rng.integers(0, 20)).tolist()
    n = sum(lengths)
    ids = rng.choice([rng.integers(0, 2**32, n), rng.integers(0, 40, n), np.full(n, 7), np.where(rng.random(n) < 0.05, 2**32 - 1, rng.integers(0, 9, n))][seed % 4 : seed % 4 + 1])
    ids = np.asarray(ids, dtype=np.uint32)
    docs = [None if i % 5 == 4 else int(i) - 3 for i in range(len(lengths))]
    data = pfor.shard(docs, lengths, ids)
    got_docs, got_lengths, got = pfor.unshard(data)
    assert got_docs == docs and got_lengths.tolist() == lengths and (got == ids).all()
    if n > 300:
        assert (pfor.unshard(data, slice(1, 2))[2] == ids[128:256]).all()
    with pytest.raises(ValueError):
        pfor.unshard(b"XXXX" + data[4:])


def test_small_widths_pack_small():
    ids = np.random.default_rng(0).integers(0, 16, 12800).astype(np.uint32)
    assert len(pfor.shard([1], [12800], ids)) < 12800 * 0.65


ROWS = [(5, "b c"), (3, None), (9, ""), (3, "dup"), (3, "dup"), (None, "no id"), (1, "w " * 30000)] + [(100 + i, t) for i, t in enumerate(odd_texts()[:60])]


def test_files_give_starts_and_digests(spark, monkeypatch):
    library = Tokenizer.from_file(WORD)
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in ROWS], "doc_id bigint, text string, start int, part string").repartition(5)
    want, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in pfor.token_files(df, WORD, 1).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert pfor.token_files(df.limit(0), WORD, 1).count() == 0


def test_counts_and_the_cache(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, t, 0) for i, t in ROWS], "doc_id bigint, text string, n_tokens int").repartition(3)
    library = Tokenizer.from_file(BYTE)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted(((i, len((t or "").encode()), n(t), n(t) > 512) for i, t in ROWS), key=str)
    where = str(tmp_path / "cache")
    assert sorted(map(tuple, tokencount.token_counts(df, BYTE, 512, where).collect()), key=str) == want
    distinct = len({t or "" for _, t in ROWS})
    assert spark.read.parquet(where).count() == distinct
    assert sorted(map(tuple, tokencount.token_counts(df, BYTE, 512, where).collect()), key=str) == want
    assert spark.read.parquet(where).count() == distinct  # nothing was missing, nothing is added
    more = df.union(spark.createDataFrame([(1000, "something new", 0)], df.schema))
    assert tokencount.token_counts(more, BYTE, 512, where).count() == len(ROWS) + 1
    assert spark.read.parquet(where).count() == distinct + 1
    assert tokencount.token_counts(df, PIECE, 512, where).count() == len(ROWS)
    assert spark.read.parquet(where).select("tokenizer").distinct().count() == 2
    assert tokencount.token_counts(df.limit(0), BYTE, 512).count() == 0


def test_a_warm_cache_moves_and_encodes_no_text(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)
    where = str(tmp_path / "cache")
    want = sorted(map(tuple, tokencount.token_counts(df, BYTE, 512, where).collect()), key=str)
    encoded, counted = [], tokencount.counted
    monkeypatch.setattr(tokencount, "counted", lambda found, path: encoded.append(found) or counted(found, path))
    warm = tokencount.token_counts(df, BYTE, 512, where)
    assert not encoded and "text" not in warm._jdf.queryExecution().toString()
    assert sorted(map(tuple, warm.collect()), key=str) == want
    more = df.union(spark.createDataFrame([(1000, "something new")], df.schema))
    assert tokencount.token_counts(more, BYTE, 512, where).count() == len(want) + 1
    plan = encoded[0]._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan.split("== Physical Plan ==")[1]


def test_counts_by_shuffle_are_the_same(spark, monkeypatch):
    df = spark.createDataFrame(ROWS * 2, "doc_id bigint, text string").repartition(3)
    want = sorted(map(tuple, tokencount.token_counts(df, BYTE, 512).collect()), key=str)
    monkeypatch.setattr(tokencount, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 40)
    assert sorted(map(tuple, tokencount.token_counts(df, BYTE, 512).collect()), key=str) == want
