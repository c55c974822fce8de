import hashlib
import random

import numpy as np
import pytest

from evaquery.llm import lpf
from evaquery.llm.queries import op11_longest_previous_factor

SF = "/root/testdata/sf0.01"


def brute(rows, length):
    """(doc_id, kept) by the definition: every window's least id over all documents."""
    least = {}
    own = [(i, lpf.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for _, key, body in own:
        for p in range(len(body) - length + 1):
            w = body[p : p + length]
            least[w] = min(least.get(w, key), key)
    out = []
    for i, key, body in own:
        gone = [False] * len(body)
        last = 0
        for p in range(len(body) - length + 1):
            if least[body[p : p + length]] < key:
                for q in range(max(p, last), p + length):
                    gone[q] = True
                last = p + length
        out.append((i, len(body), gone, bytes(b for b, g in zip(body, gone) if not g)))
    return out


def shown(found):
    out = []
    for i, n, gone, kept in found:
        edges = [k for k in range(n + 1) if (gone[k - 1] if k else False) != (gone[k] if k < n else False)]
        out.append((i, n, [(a, b) for a, b in zip(edges[::2], edges[1::2])], kept))
    return sorted(map(str, out))


def got(df):
    return sorted(str((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept))) for r in df.collect())


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé\n ") for _ in range(rnd.randint(1, 4)))
    passages = ["".join(word() for _ in range(rnd.randint(2, 30))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(passages)[rnd.randint(0, 6) :] if rnd.random() < 0.5 else "".join(word() for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 5))]
        rows.append((rnd.choice([i, i, 7, None]), "".join(parts)))
    return rows + [(3, rows[5][1]), (None, rows[5][1]), (900, None), (901, ""), (901, ""), (902, "ab" * 40), (903, "ab" * 41), (904, "a" * 300), (2, "a" * 290)]


@pytest.mark.parametrize(("seed", "length", "kmer", "bucket"), [(1, 50, 20, 20_000), (2, 12, 5, 20_000), (3, 12, 5, 1), (4, 9, 8, 3)])
def test_against_every_window(spark, seed, length, kmer, bucket):
    rows = corpus(seed)
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id bigint, row string, id int")
    assert got(lpf.without_repeats(docs, length=length, kmer=kmer, bucket=bucket)) == shown(brute(rows, length))


def test_long_texts_and_cut_passages(spark):
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    long = "".join(rnd.choice("abcdefgh ") for _ in range(3 * lpf.BLOCK + 50_000))
    edge = lpf.BLOCK - 200
    rows = [(1, passage), (2, long[:edge] + passage + long[edge:]), (3, long[edge - 3000 : edge + 4000]), (4, passage[100:149]), (5, "z" + passage[100:150] + "z")]
    found = {r.doc_id: r for r in lpf.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(s.start, s.end) for s in found[2].spans] == [(edge, edge + 400)]
    assert len(found[3].kept) < 100 and found[4].spans == [] and [(s.start, s.end) for s in found[5].spans] == [(1, 51)]
    assert found[1].spans == []


def test_empty_table(spark):
    assert lpf.without_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_longest_previous_by_all_pairs():
    rnd = random.Random(3)
    for _ in range(200):
        own = sorted(("".join(rnd.choice("ab") for _ in range(6)), rnd.randint(0, 5)) for _ in range(rnd.randint(1, 12)))
        shared = lambda a, b: next((k for k in range(6) if a[k] != b[k]), 6)
        common = [0, *(shared(a[0], b[0]) for a, b in zip(own, own[1:]))]
        want = [max([shared(a, b) for b, j in own if j < i], default=0) for a, i in own]
        assert lpf.longest_previous([i for _, i in own], common) == want


def test_equal_windows_share_anchors():
    rnd = random.Random(8)
    window = bytes(rnd.randrange(256) for _ in range(50))
    seen = set()
    for _ in range(30):
        body = bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 90))) + window + bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 90)))
        block = next(lpf.blocks([b"x" * 60, body], 50))
        made = lpf.chunks(block, 50, 20)
        at = block.raw.index(window)
        seen.add(int(made.anchor[np.flatnonzero((made.first <= at) & (at <= made.last))[0]]))
        assert sum((made.last - made.first + 1).tolist()) == 11 + len(body) - 49
    assert len(seen) == 1


def test_query_keeps_its_digests(spark):
    rows = {r.doc_id: r for r in op11_longest_previous_factor(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(rows) == set(texts) and sum(r.n_spans > 0 for r in rows.values()) > 50
    for i, r in rows.items():
        if not r.n_spans:
            assert r.kept_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() and r.n_bytes == len(texts[i].encode())
