import hashlib
import random
import re

import pytest

from evaquery.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(i, text):
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return (i, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    rnd = random.Random(12)
    odd = [None, "", " ", "a", " a", "a ", "\n\ta\x0b b\x1c c  ", "<P>", "x <M> y", "<p>", "😀 é\r\n😀", "w " * 50_000, "x" * 30_000]
    return odd + ["".join(rnd.choice("ab é😀 \t\n<>PS") for _ in range(rnd.randint(0, 60))) for _ in range(400)]


def test_against_lists_of_tokens(spark):
    rows = [(rnd, t) for rnd, t in enumerate(texts())] + [(None, "a b c"), (None, "a b c"), (5, "q r s t")]
    docs = spark.createDataFrame([(t, i, "x", 2) for i, t in rows], "text string, doc_id bigint, output string, n int")
    made = fim.fill_in_middle(docs)
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(str(brute(*r)) for r in rows)
    forms = {r.form for r in made.collect()}
    assert forms == {"plain", "psm", "spm"}
    digests = [(r.doc_id, r.restored_sha256) for r in fim.report(made).collect()]
    assert sorted(map(str, digests)) == sorted(str((i, hashlib.sha256((t or "").encode()).hexdigest())) for i, t in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["token", "char"])
def test_every_cut_of_the_runs(unit):
    for text in texts():
        units = TOKEN.findall(text or "") if unit == "token" else list(text or "")
        if len(units) > 2000:
            units, text = units[:2000], "".join(units[:2000])
        own = fim.runs(text or "", unit)
        assert own.n == len(units)
        at = 0
        for cut, u in enumerate([*units, ""]):
            assert own.offset(cut) == at
            at += len(u)
