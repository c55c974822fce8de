import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evaquery.llm import rules
from evaquery.llm.queries import op2_quality_rules

SF = "/root/testdata/sf0.01"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def base(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def classes(text):
    kinds = [0] * 6
    for c in text:
        cat = unicodedata.category(c)
        kinds[0 if cat == "Ll" else 1 if c in " \t\n\x0b\f\r" else 2 if cat == "Lu" else 3 if c in ".,;:!?'\"()-" else 4 if c in "0123456789" else 5] += 1
    return kinds


def commons(text, lang):
    low = [w.lower() for w in words(text)]
    got = [low.count(w) for w in rules.COMMON_WORDS[lang]]
    return got + [0] * (rules.LONGEST - len(got)) + [len(low) - sum(got)]


def distance(a, b):
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    kl = lambda u: sum(x * math.log2(x / ((y + z) / 2)) for x, y, z in zip(u, p, q) if x)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def judged(rows):
    ok = [(t or "", lang) for _, t, lang in rows if not base(t)[5] and lang in rules.COMMON_WORDS]
    refs = {lang: [[sum(c) for c in zip(*(f(t) for t, own in ok if own == lang))] for f in (classes, lambda t, lang=lang: commons(t, lang))] for lang in {own for _, own in ok}}
    out = []
    for i, t, lang in rows:
        b = base(t)
        bad = b[5]
        if lang in refs:
            bad |= b[0] >= 60 and distance(classes(t or ""), refs[lang][0]) > 0.3
            bad |= b[0] >= 120 and distance(commons(t or "", lang), refs[lang][1]) > 0.3
        out.append((i, *b, not bad))
    return out


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in op2_quality_rules(spark, SF).collect())
    want = sorted(judged(rows))
    assert got == want
    assert 0 < sum(not r[-1] and not r[-2] for r in want) < 200


def test_odd_texts(spark):
    rnd = random.Random(4)
    rows = [(1, None, "en"), (2, "", None), (2, "", None), (None, " \n\t", "xx"), (3, "a b c d e a b c d e", "en"), (4, "a b\na b\n\n \n", "de"), (5, "a " * 5, "en"), (6, "w " * 20000, "en"), (7, "É%$ ñ\x0bü\x1c| <b>", "fr"), (8, " ".join(str(i) for i in range(20000)) + " 0 1 2 3 4", "en")]
    rows += [(100 + i, rnd.choice("  \n").join(rnd.choice("ab") for _ in range(rnd.randint(1, 40))), "es") for i in range(60)]
    df = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in rows], "doc_id bigint, text string, lang string, words string")
    got = sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in rules.quality_rules(df).collect())))
    assert got == sorted(map(str, judged(rows)))
    assert rules.quality_rules(df.limit(0)).count() == 0


def test_divergence(spark):
    got = spark.range(1).select(rules.divergence(F.array(F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(9))).alias("far"), rules.divergence(F.array(F.lit(1), F.lit(3)), F.array(F.lit(2), F.lit(6))).alias("same"), rules.divergence(F.array(F.lit(0)), F.array(F.lit(1))).alias("none")).first()
    assert got.far == pytest.approx(1) and got.same == pytest.approx(0) and got.none is None


def test_no_python_in_the_plan(spark):
    plan = op2_quality_rules(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
