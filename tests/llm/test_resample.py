import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from evaquery.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, n):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(low)
    grams = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return words, [zlib.crc32(g.encode()) % 10_000 for g in grams]


def brute(rows, target, n):
    own = [(i, *features(t, n)) for i, t in rows]
    s = Counter(b for _, _, f in own for b in f)
    t = Counter(b for text in target for b in features(text, n)[1])
    all_s, all_t = s.total() + 10_000.0, t.total() + 10_000.0
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t)))
    out = []
    for i, words, f in own:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= 20])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: len(fit) // 10], 1):
        r[4] = place
    return sorted(str(tuple(r[:5])) for r in out)


def corpus():
    rnd = random.Random(21)
    words = ["Ab", "cd", "é", "x1", "the", "of", "ÀB", "日本", "z" * 50]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "-", "\n", ", ", "\x00", "_"]) for _ in range(n))
    rows = [(i, text(rnd.choice([0, 3, 19, 20, 40, 200]))) for i in range(300)]
    long = text(40_000)
    return rows + [(None, None), (None, "a b"), (1000, ""), (1001, long), (1001, long), (1002, long + "q" * 200_000), (1003, "-" * 100_000)], [text(50) for _ in range(4)] + [None]


@pytest.mark.parametrize(("n", "size"), [(1, 1 << 16), (1, 64), (2, 100), (3, 7)])
def test_against_lists_of_words(spark, n, size):
    rows, target = corpus()
    if size < 1000:
        rows = [(i, t and t[:4000]) for i, t in rows]
    docs = spark.createDataFrame([(t, i, 1, "x") for i, t in rows], "text string, doc_id bigint, rank int, row string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample.resampled(docs, wanted, n=n, size=size)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in found.collect()) == brute(rows, target, n)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resample.resampled(none, none.select("text")).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id bigint, text string")
    assert [r.n_features for r in resample.resampled(one, none.select("text"), n=1).collect()] == [30]


def test_chunks_own_every_start():
    rnd = random.Random(2)
    for _ in range(300):
        folded = "".join(rnd.choice(["a", "bb", " ", "  ", "ccc"]) for _ in range(rnd.randint(0, 60))).encode()
        n, size = rnd.randint(1, 4), rnd.randint(1, 20)
        hashed = resample.Hashed(97)
        whole = Counter(hashed.of(folded, b"", n)[1].tolist())
        parts = Counter(x for own, carry in resample.pieces(folded, size, n) for x in hashed.of(own, carry, n)[1].tolist())
        assert whole == parts
