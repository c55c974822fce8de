import random

import numpy as np

from evaquery.llm import decontaminate as dc

SF = "/root/testdata/sf0.01"


def best(item, doc):
    """Semi-global edit distance, the plain way."""
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, v in enumerate(doc):
            new.append(min(row[j] + (v != w), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(docs, items, similarity=0.8):
    out = []
    for i, t in docs:
        d = dc.words(t)
        for k, x in items:
            w = dc.words(x)
            if w and (e := best(w, d)) <= int((1 - similarity) * len(w) + 1e-9):
                out.append((i, k, e))
    return sorted(out, key=str)


def corpus(seed=1, n_items=25, n_docs=150, edits=0.2):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)] + ["the", "of"] * 12
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 4, 5, 9, 15, 22, 40, 57])))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        text = [rnd.choice(vocab) for _ in range(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 2)):
            own = rnd.choice(items)[1].split()
            for _ in range(rnd.randint(0, int(edits * len(own)))):
                at = rnd.randrange(len(own) + 1)
                own[at : at + rnd.randint(0, 1)] = [rnd.choice(vocab)] * rnd.randint(0, 1)
            at = rnd.randint(0, len(text))
            text[at:at] = own
        docs.append((i, ". ".join(text).title() if i % 3 else "\n".join(text)))
    return docs, items


def test_finds_what_brute_force_finds():
    found = missed = 0
    for seed in range(6):
        docs, items = corpus(seed)
        block = dc.Items(items)
        got = {(docs[d][0], block.ids[i], e) for d, i, e, _ in block.find([t for _, t in docs])}
        want = set(brute(docs, items))
        assert {g[:2] for g in got} <= {w[:2] for w in want}
        found += len(want)
        missed += len({w[:2] for w in want} - {g[:2] for g in got})
    assert found > 400 and missed <= 0.01 * found, (found, missed)


def edited(own, k, rnd):
    own = list(own)
    for _ in range(k):
        at = rnd.randrange(len(own))
        own[at : at + rnd.randint(0, 1)] = ["other%d" % rnd.randrange(10**6)] * rnd.randint(0, 1)
    return own


def test_agreement_at_the_threshold_is_at_least_what_the_repetitions_assume():
    rnd, agree = random.Random(0), []
    for n in [*range(15, dc.PIECE_WORDS + 1, 3)] * 4:
        item = ["w%d" % rnd.randrange(5000) for _ in range(n)]
        block = dc.Items([(0, " ".join(item))])
        own = edited(item, int(block.edits[0]), rnd)
        flat = np.array([block.vocabulary.get(w, -1) for w in own])
        for q, (_, first, _, rep, step, _, _, _) in block.buckets.items():
            text = dc.symbols(flat, q)
            at = block._walked(text, np.zeros(len(rep), dtype=np.int64), rep, step)
            symbol = np.repeat(block.buckets[q][0], np.diff(first))
            agree.append((np.append(text, 0)[np.minimum(at, len(text))] == symbol).mean())
    assert np.mean(agree) >= dc.AGREEMENT


def test_long_items_are_found_at_the_threshold():
    rnd, found, asked = random.Random(5), 0, 0
    for n in (60, 100, 200, 500, 900):
        items = [(i, " ".join("w%d" % rnd.randrange(3000) for _ in range(n))) for i in range(12)]
        block = dc.Items(items)
        docs = [" ".join(["pad"] * 30 + edited(t.split(), n // 5, rnd) + ["pad"] * 30) for _, t in items]
        got = {(d, i) for d, i, *_ in block.find(docs)}
        asked += len(items)
        found += sum((i, i) in got for i in range(len(items)))
    assert found >= 0.99 * asked, (found, asked)


def test_frames(spark):
    docs, items = corpus(9)
    docs += [(500, None), (501, ""), (None, items[5][1] + " tail"), (502, "x " * 60000 + items[6][1])]
    items += [(90, None), (91, " .,"), (None, "alpha beta gamma delta epsilon zeta")]
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id bigint, text string, item_id int, edits string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id) for r in dc.contamination(d, b).collect()), key=str)
    short = [(i, t) for i, t in docs if i != 502]
    want = sorted({(i, k) for i, k, _ in brute(short, items)} | {(502, 6)} | {(502, k) for i, k in got if i == 502}, key=str)
    assert got == want
    clean = dc.decontaminated(d, b)
    assert clean.columns == d.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((i for i, _ in docs if i not in {g[0] for g in got}), key=str)
    assert dc.contamination(d.limit(0), b).count() == 0 and dc.contamination(d, b.limit(0)).count() == 0
    assert dc.decontaminated(d, b.limit(0)).count() == len(docs)


def test_blocks_find_the_same(spark, monkeypatch):
    docs, items = corpus(11, n_docs=40)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted((r.doc_id, r.item_id) for r in dc.contamination(d, b).collect())
    monkeypatch.setattr(dc, "BLOCK_CHARS", 900)
    assert sorted((r.doc_id, r.item_id) for r in dc.contamination(d, b).collect()) == whole and whole
