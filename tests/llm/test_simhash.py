import random

import numpy as np
import pytest
import xxhash

from evaquery.llm import common, simhash


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    comp = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, f in fps:
            for j, g in fps:
                if bin(f ^ g).count("1") <= 4 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return comp


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcÉdeX") for _ in range(rnd.randint(1, 6)))
    rows = []
    for i in range(60):
        rows.append((i, rnd.choice([" ", "\n", "\t\x0b"]).join(word() for _ in range(rnd.choice([1, 3, 4, 5, 80])))))
    for i in range(60, 110):
        words = rows[rnd.randrange(60)][1].split()
        words[rnd.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(110, rows[3][1]), (111, rows[3][1]), (112, None), (113, ""), (114, " \n")]
    base = [word() for _ in range(300)]
    for i in range(115, 150):
        edited = list(base)
        edited[rnd.randrange(300)] = word()
        rows.append((i, " ".join(edited)))
    return rows


def shingles(text, n=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def alike_pairs(sets, least):
    """(a, b, similarity) of all pairs with a Jaccard similarity of ``least`` or more, found by shared shingles."""
    at = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    shared = {}
    for ids in at.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[a, b] = shared.get((a, b), 0) + 1
    sims = ((a, b, n / (len(sets[a]) + len(sets[b]) - n)) for (a, b), n in shared.items())
    return [(min(a, b), max(a, b), j) for a, b, j in sims if j >= least]


def components(ids, links):
    own = {i: i for i in ids}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        own[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def edited_corpus(seed=2):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    rows, at = [], 0
    for _ in range(120):
        base = [word() for _ in range(rnd.choice([60, 200, 700]))]
        for share in (0, 0.004, 0.01, 0.018, 0.03, 0.1):
            own = [word() if rnd.random() < share else w for w in base]
            rows.append((at, " ".join(own)))
            at += 1
    return rows


def check_groups(got, sets, least_recall):
    """Every group is connected by pairs at 0.8 or more, and such pairs share a group."""
    near = alike_pairs(sets, 0.8)
    reach = components(sets, [(a, b) for a, b, _ in near])
    assert sum(got[a] == got[b] for a, b, _ in near) >= least_recall * len(near)
    for i, c in got.items():
        assert c <= i and reach[c] == reach[i]
    return near


def test_groups_of_similar_texts(spark):
    rows = edited_corpus()
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(check_groups(got, {i: shingles(t) for i, t in rows}, 0.97)) > 500


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_groups_of_the_tables_texts(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    texts, first = {}, {}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        first[r.doc_id] = texts.setdefault(r.text, r.doc_id)
    assert all(got[i] == got[j] for i, j in first.items())
    near = check_groups({i: got[i] for i in texts.values()}, {i: shingles(t) for t, i in texts.items()}, 0.95)
    assert len(near) >= 5


def test_verified_groups_of_odd_rows(spark):
    rows = [(900, None), (901, ""), (None, "x y"), (902, "x y"), (902, "x y"), (903, "X  y"), (904, "x y z"), (None, "only without an id here and there"), (905, "a b c d e f a b c d e f"), (906, "a b c d e f a b c d e f a b c d e f")]
    own = simhash.similar_documents(spark.createDataFrame([(i, t, 0, "f") for i, t in rows], "doc_id bigint, text string, component_id int, fp string"))
    want = [(900, 900), (901, 900), (None, 902), (902, 902), (902, 902), (903, 902), (904, 904), (None, None), (905, 905), (906, 905)]
    assert sorted(((r.doc_id, r.component_id) for r in own.collect()), key=str) == sorted(want, key=str)
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_similar_pairs_connect_like_all_pairs():
    rows = edited_corpus(6)[:240]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for _, t in rows]
    fps = np.frombuffer(b"".join(simhash.wide_fingerprint(s)[: simhash.SHORT] for s in sets), dtype="<u8").reshape(len(sets), -1)
    pairs = simhash.similar_pairs(fps, sets, 0.8)
    own = dict(enumerate(map(set, map(np.ndarray.tolist, sets))))
    assert all(len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]) for a, b in pairs)
    assert components(own, pairs) == components(own, [(a, b) for a, b, _ in alike_pairs(own, 0.8)])


def test_buckets_in_tiles_give_the_same(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    wide = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    monkeypatch.setattr(simhash, "CHUNK", 6)
    monkeypatch.setattr(simhash, "SET_BYTES", 20_000)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 30)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == wide


def test_fingerprint_and_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, fp string, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [(i, brute_fp(t)) for i, t in rows]
    comp = brute_components(fps)
    assert got == {i: (f"{f:016x}", comp[i]) for i, f in fps}
    assert len(set(comp.values())) < len(rows) - 10


def test_masks_cover_every_close_pair():
    masks = simhash.block_masks(4)
    rnd = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(not diff & m for m in masks)


def test_forest_connects_like_all_pairs():
    rnd = np.random.default_rng(0)
    base = rnd.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.array([b ^ np.uint64(sum(1 << int(x) for x in rnd.choice(64, rnd.integers(0, 5), False))) for b in base for _ in range(20)], dtype=np.uint64))
    links = simhash.forest(fps, 4)
    comp = brute_components([(i, int(f)) for i, f in enumerate(fps)])
    own = list(range(len(fps)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        assert bin(int(fps[a] ^ fps[b])).count("1") <= 4
        own[root(a)] = root(b)
    assert len({root(i) for i in range(len(fps))}) == len(set(comp.values())) and len(links) < len(fps)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b"), (None, "zz")], "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("None", "4"), ("None", "4"), ("None", "None")]
