"""op7 compares lines token by token, in groups within a leaf."""

from evaquery.llm import templates
from evaquery.llm.queries import op7_line_templates

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string"


def dropped(spark, texts):
    rows = list(enumerate(texts))
    return [r.n_dropped for r in templates.line_dedup(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()]


def test_long_lines_agree_by_token(spark):
    words = [f"word{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'xyz'[k // 26]}" for k in range(57)]
    lines = [" ".join(w + x if k in (10, 22, 34, 46) else w for k, w in enumerate(words)) for x in ("one", "two", "three")]
    assert dropped(spark, lines) == [0, 1, 1]
    far = [" ".join(w + x if 10 <= k < 22 else w for k, w in enumerate(words)) for x in ("one", "two")]
    assert dropped(spark, far) == [0, 0]


def test_an_unlike_line_undoes_no_template(spark):
    log = ["job in queue was started by user %s on the main host" % x for x in ("anna", "bert", "carl")]
    other = ["job in queue gives no reason to wait for all other things", "job in queue gives no reason to wait for all many things"]
    assert dropped(spark, [log[0], other[0], log[1], "job in queue whose name is not any that we all know", log[2], other[1]]) == [0, 0, 1, 0, 1, 1]


def test_wildcards_count_as_tokens(spark):
    texts = ["Licensed under CC BY-NC 4.0.\nown alpha", "Licensed under CC BY-NC 4.0.\nown beta", "Licensed under CC BY-NC 4.1.", "1 2 3 4 5", "1 2 3 4 6", "one two three 4"]
    assert dropped(spark, texts + ["one two three 4\n"]) == [0, 1, 1, 0, 0, 0, 0]


def test_all_lines_of_the_table(spark):
    assert sum(r.n_dropped for r in op7_line_templates(spark, SF).collect()) == 922
