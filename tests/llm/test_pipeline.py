import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402

from evaquery.llm import decontaminate, simhash  # noqa: E402
from evaquery.llm.sample import fold  # noqa: E402

from . import test_bpe, test_decontaminate, test_simhash, test_templates  # noqa: E402

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage, each written and read again."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(at / str(i)))
        made = spark.read.parquet(str(at / str(i)))
        out.append((name, docs, made))
        docs = made
    return out


def test_columns_and_order(stages):
    assert [s[0] for s in stages] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for _, _, made in stages[:-1]:
        assert made.columns == COLUMNS


def test_classifier_keeps_clean_documents(stages, spark):
    _, docs, made = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").where(fold(F.col("doc_id"), 3) == 1).collect()}
    kept = {r.doc_id for r in made.select("doc_id").collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.05 * len(bad)
    assert made.exceptAll(docs).count() == 0


def test_line_dedup_is_the_brute_force_one(stages):
    _, docs, made = stages[1]
    want = {r[0]: r[3] for r in test_templates.brute([tuple(r) for r in docs.select("doc_id", "text").collect()])}
    got = {r.doc_id: (r.text, r.n_chars) for r in made.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_near_dedup_keeps_one_of_each_group(stages):
    _, docs, made = stages[2]
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in made.collect()}
    sets = {i: test_simhash.shingles(t) for i, t in rows.items()}
    alike = test_simhash.alike_pairs(sets, 0.8)
    assert len(alike) > 20 and sum(a in kept and b in kept for a, b, _ in alike) <= 0.1 * len(alike)
    near = {i for a, b, _ in test_simhash.alike_pairs(sets, 0.65) for i in (a, b)}
    assert set(rows) - kept <= near  # whatever goes is close to something
    least = test_simhash.components(rows, [(a, b) for a, b, _ in test_simhash.alike_pairs(sets, 0.999)])
    assert all(least[i] == i for i in kept)  # of equal ones only the first stays
    assert made.exceptAll(docs).count() == 0 and made.count() < docs.count()


def test_decontamination_is_the_brute_force_one(stages, spark):
    _, docs, made = stages[3]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    block = decontaminate.Items(items)
    seeds = {w for _, t in items for w in zip(*(decontaminate.words(t)[k:] for k in range(3)))}
    near = [(r.doc_id, r.text) for r in docs.collect() if seeds & set(zip(*(decontaminate.words(r.text)[k:] for k in range(3))))]
    bad = {i for i, _, _ in test_decontaminate.brute([(i, t) for i, t in near if len(t) < 4000], items)}
    bad |= {near[d][0] for d, *_ in block.find([t for _, t in near]) if len(near[d][1]) >= 4000}
    assert sorted(r.doc_id for r in made.select("doc_id").collect()) == sorted(set(r.doc_id for r in docs.collect()) - bad)
    assert made.exceptAll(docs).count() == 0


def test_last_stage_is_the_library(stages):
    import hashlib

    _, docs, made = stages[4]
    lib = test_bpe.library(test_bpe.PATH)
    got = {r.doc_id: r for r in made.collect()}
    for r in docs.collect():
        ids = lib.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_gives_the_last_stage(stages, spark):
    got = {tuple(r) for r in pipeline.run(spark, SF).collect()}
    assert got == {tuple(r) for r in stages[4][2].collect()}


def test_representatives_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (None, "a b"), (3, None), (4, ""), (7, "z z z")], "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in simhash.representatives(df).collect()) == ["1", "3", "7", "None"]
    assert simhash.representatives(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_stages_on_odd_tables(spark, rows):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, None, "en", "s", 5), (1, None, "en", "s", 5), (2, "", None, None, 0), (3, "plain words " * 9000, "en", "s", None), (None, "some words without an id", "xx", "s", 7)]
    docs = spark.createDataFrame(odd if rows == "odd" else [], schema).withColumns({"row": F.lit(1), "fp": F.lit("x")})
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, SF)
        got = made.collect()
        assert len(got) <= docs.count() and (rows == "odd" or not got)
        if name != "byte_bpe":
            assert made.columns == docs.columns
    assert len(got) == len(odd) * (rows == "odd")


def test_scratch_files_go_and_results_stay(spark):
    from pathlib import Path

    from evaquery.llm import common

    at = Path(common.shared_dir(spark).replace("file:", ""))
    before = set(at.glob("evaquery-*"))
    with common.scratch(spark):
        common.stored(spark.range(3))
        kept = common.stored(common.stored(spark.range(5)), keep=True)
    assert len(set(at.glob("evaquery-*")) - before) == 1 and kept.count() == 5
