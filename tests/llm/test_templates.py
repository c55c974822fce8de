import random
import re
from collections import defaultdict

import xxhash

from evaquery.llm import common, templates
from evaquery.llm.queries import op7_line_templates

SF = "/root/testdata/sf0.01"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def tokens(line):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
    return ["<*>" if re.search(r"[0-9@]|://", x) else x for x in w]


def families(templates_, depth, similarity):
    """Each template's family: the least that chains of alike templates of its leaf reach, by all pairs."""
    own = {t: t for t in templates_}
    leaves = defaultdict(list)
    for t in templates_:
        leaves[len(t), t[:depth]].append(t)

    def root(t):
        while own[t] != t:
            t = own[t]
        return t

    for ts in leaves.values():
        for i, a in enumerate(ts):
            for b in ts[:i]:
                if sum(x != y for x, y in zip(a, b)) <= int((1 - similarity) * len(a) + 1e-9):
                    own[max(root(a), root(b))] = min(root(a), root(b))
    return {t: root(t) for t in templates_}


def brute(rows, depth=3, least=5, similarity=0.8):
    lines = []
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            tok = tokens(line)
            if len(tok) >= least and set(tok) != {"<*>"}:
                lines.append((i, t or "", pos, tuple(tok)))
    family = families({tok for *_, tok in lines}, depth, similarity)
    seen = defaultdict(list)
    for i, t, pos, tok in lines:
        seen[family[tok]].append((i is None, i or 0, signed(xxhash.xxh64_intdigest(t.encode(), 42)), pos, i, t))
    drop = defaultdict(set)
    for places in seen.values():
        if len({p[5] for p in places}) > 1:
            first = min(places)[:4]
            for p in places:
                if p[:4] != first:
                    drop[p[4], p[5]].add(p[3])
    out = []
    for i, t in rows:
        d = drop[i, t or ""]
        text = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in d)
        out.append((i, 0 if t is None else t.count("\n") + 1, len(d), text))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, op7_line_templates(spark, SF).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 100


def test_odd_rows(spark):
    rnd = random.Random(8)
    stock = ["long " + " ".join("tok%s" % chr(97 + k % 26) for k in range(40)) + " tail %s end" % x for x in "abc"] + ["user 17 logged in from 10.0.0.%d at noon" % i for i in range(5)] + ["All rights reserved by the owner Smith", "All rights reserved by the owner Jones", "one two three four five six", "\t padded  line of five  words ", "short line", "", " "]
    rows = [(i, "\n".join(rnd.choice(stock + ["body %s line of document number x" % "".join(rnd.choice("abc") for _ in range(9))]) for _ in range(rnd.randint(1, 9)))) for i in range(60)]
    rows += [(3, None), (None, None), (None, rows[4][1]), (7, rows[7][1]), (7, rows[7][1]), (8, "a b c d e f g\n" * 500), (200, "a b c d e f g"), (201, ""), (202, "x" * 100000)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, key int, `row.x` string").repartition(3)
    got = sorted(map(tuple, templates.line_dedup(df).collect()), key=str)
    assert got == brute(rows)
    kept = templates.without_recurring_lines(df)
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert templates.line_dedup(df.limit(0)).count() == 0


def test_large_branches_are_split(spark, monkeypatch):
    rnd = random.Random(3)
    rows = []
    for i in range(160):
        kind = rnd.choice("pqr")
        n = rnd.choice([5, 9, 14, 31])
        words = ["lead", "of", kind[0] * rnd.randint(1, 2)] + [f"{kind}{chr(97 + k % 26)}" for k in range(n - 3)]
        for _ in range(rnd.randint(0, n // 3)):
            words[rnd.randrange(3, n)] = "".join(rnd.choice("xyz") for _ in range(3))
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    for size, tile in ((1, 5), (4, 128), (1000, 128)):
        monkeypatch.setattr(templates, "ROW_GROUP", size)
        monkeypatch.setattr(templates, "TILE", tile)
        assert sorted(map(tuple, templates.line_dedup(df).collect()), key=str) == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, templates.line_dedup(df).collect()), key=str) == want


def test_more_documents_keep_no_more_lines(spark):
    rnd = random.Random(9)
    stock = ["worker %s took the %s job from the queue" % (a, b) for a in ("ann", "bob", "cyd", "dan") for b in ("red", "blue", "grey")] + ["worker %s has no job and waits for all others" % a for a in ("ann", "eve", "bob")]
    rows = [(i, "\n".join(rnd.choice(stock) for _ in range(3)) + "\nown %d" % i) for i in range(40)]
    few = {r[0]: r[2] for r in map(tuple, templates.line_dedup(spark.createDataFrame(rows[:9], "doc_id bigint, text string")).collect())}
    many = {r[0]: r[2] for r in map(tuple, templates.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())}
    assert all(many[i] >= n for i, n in few.items()) and sum(few.values()) > 5


def test_copies_keep_their_lines_and_one_line_stays(spark):
    line = "the same passage of more than five words"
    rows = [(1, line + "\nown alpha"), (2, line + "\nown beta"), (3, line + "\nown beta"), (4, "unique words that nobody else has here"), (5, "unique words that nobody else has here")]
    got = {r.doc_id: r.text for r in templates.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "own beta", 3: "own beta", 4: rows[3][1], 5: rows[4][1]}


def test_no_python_in_the_plan(spark):
    plan = op7_line_templates(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
