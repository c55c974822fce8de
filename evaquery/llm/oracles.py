"""DuckDB SQL for the operators that SQL can express, over the table ``documents``."""

from __future__ import annotations

from . import rules


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


TOKENS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def line_templates(depth: int = 3, least: int = 5, similarity: float = 0.8) -> str:
    """``op7``: templates by token count and leading tokens, alike ones of a leaf connected, later lines dropped."""
    return rf"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
t AS (SELECT *, list_transform({TOKENS.format('line')}, lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END) AS tok FROM l),
k AS MATERIALIZED (SELECT *, len(tok) AS n, array_to_string(tok, ' ') AS template, len(tok) || ' ' || array_to_string(tok[1:{depth}], ' ') AS leaf FROM t
 WHERE len(tok) >= {least} AND len(list_filter(tok, lambda x: x <> '<*>')) > 0),
u AS MATERIALIZED (SELECT DISTINCT leaf, n, tok, template FROM k),
p AS MATERIALIZED (SELECT a.template AS a, b.template AS b FROM u a JOIN u b ON a.leaf = b.leaf AND a.template <> b.template
 AND len(list_filter(list_zip(a.tok, b.tok), lambda z: z[1] <> z[2])) <= floor((1 - {similarity}) * a.n + 1e-9)),
r(template, root) AS (SELECT DISTINCT a, a FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.template),
g AS (SELECT template, min(root) AS key FROM r GROUP BY template),
e AS (SELECT k.doc_id, k.text, k.pos, coalesce(g.key, k.template) AS key FROM k LEFT JOIN g USING (template)),
f AS (SELECT key, min((doc_id, pos)) AS first FROM e GROUP BY key HAVING count(DISTINCT text) > 1),
d AS (SELECT DISTINCT e.doc_id, e.pos FROM e JOIN f USING (key) WHERE (e.doc_id, e.pos) <> f.first)
SELECT l.doc_id, count(*) AS n_lines, count(d.pos) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE d.pos IS NULL), '') AS text
FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.pos = l.pos GROUP BY l.doc_id"""


def _divergence(a: str, b: str) -> str:
    """Jensen-Shannon distance of two list columns of counts."""
    p, q = (f"list_transform({x}, lambda v: v / list_sum({x})::DOUBLE)" for x in (a, b))
    part = "(CASE WHEN z[{0}] > 0 THEN z[{0}] * log2(z[{0}] / ((z[1] + z[2]) / 2)) ELSE 0 END)"
    return f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: ({part.format(1)} + {part.format(2)}) / 2)))) END"


def quality_rules(window: int = 5, least: int = 10, repeated: int = 20, class_words: int = 60, class_distance: float = 0.3, common_words: int = 120, common_distance: float = 0.3) -> str:
    """``op2``: base counts, and both histograms against sums over the language's passing documents."""
    removed = ["coalesce(text, '')"]
    for pattern in (r"\p{Ll}+", r"[\x20\x09-\x0D]+", r"\p{Lu}+", "[.,;:!?''\"()-]+", "[0-9]+"):
        removed.append(f"regexp_replace({removed[-1]}, '{pattern}', '', 'g')")
    sizes = [f"length({r})" for r in removed] + ["0"]
    classes = "[" + ", ".join(f"{a} - {b}" for a, b in zip(sizes, sizes[1:])) + "]"
    counts = " ".join(f"WHEN '{lang}' THEN list_transform({_list(w + ['-'] * (rules.LONGEST - len(w)))}, lambda c: CASE WHEN c = '-' THEN 0 ELSE len(list_filter(low, lambda x: x = c)) END)" for lang, w in rules.COMMON_WORDS.items())
    summed = lambda name, n: "[" + ", ".join(f"sum({name}[{i + 1}])" for i in range(n)) + "]"
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, {TOKENS.format('text')} AS words FROM documents),
x AS (SELECT *, list_transform(words, lambda x: lower(x)) AS low, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (SELECT rid, unnest(range(0, len(words) - {window - 1})) AS st, unnest(list_transform(range(0, len(words) - {window - 1}), lambda i: array_to_string(words[i + 1:i + {window}], ' '))) AS gram FROM w WHERE len(words) > {window}),
r AS (SELECT rid, count(DISTINCT st + k) AS n FROM (SELECT rid, st, count(*) OVER (PARTITION BY rid, gram) AS c FROM g), range(0, {window}) o(k) WHERE c > 1 GROUP BY rid),
b AS (SELECT x.rid, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {classes} AS classes, CASE lang {counts} END AS commons FROM x LEFT JOIN r USING (rid)),
c AS (SELECT * REPLACE (list_append(commons, n_words - list_sum(commons)) AS commons), n_words < {least} OR 100 * n_repeat_words > {repeated} * n_words AS base_failed FROM b),
f AS (SELECT lang, {summed('classes', 6)} AS rc, {summed('commons', rules.LONGEST + 1)} AS rw FROM c WHERE NOT base_failed AND lang IN {tuple(rules.COMMON_WORDS)} GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT coalesce(n_words >= {class_words} AND {_divergence('classes', 'rc')} > {class_distance}, false) AND NOT coalesce(n_words >= {common_words} AND {_divergence('commons', 'rw')} > {common_distance}, false) AS kept
FROM c LEFT JOIN f USING (lang)"""


def repeats(length: int = 50) -> str:
    """``op11``: every window of every text, those of an earlier document joined to islands; bytes as hex digits."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT rid, id, unnest(range(0, length(x) // 2 - {length - 1})) AS p, unnest(list_transform(range(0, length(x) // 2 - {length - 1}), lambda p: substr(x, 2 * p + 1, {2 * length}))) AS s FROM d),
f AS (SELECT s, min(id) AS least FROM w GROUP BY s HAVING min(id) < max(id)),
i AS (SELECT rid, p, coalesce(p > lag(p) OVER (PARTITION BY rid ORDER BY p) + {length}, true) AS opens FROM w JOIN f USING (s) WHERE least < id),
g AS (SELECT rid, p, sum(opens::INT) OVER (PARTITION BY rid ORDER BY p) AS island FROM i),
s AS (SELECT rid, min(p) AS a, max(p) + {length} AS b FROM g GROUP BY rid, island),
k AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS last FROM s),
r AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head, max(b) AS last FROM k JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN r USING (rid)"""


def fill_in_middle(percent: int = 50, spm_percent: int = 80, seed: str = "42") -> str:
    """``op12``: lists of tokens, cut by slices."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(tok) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(s, i, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
 CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= {percent} THEN 'plain' WHEN h[4] % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(tok[1:a], '') AS pre, array_to_string(tok[a + 1:b], '') AS mid, array_to_string(tok[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
 sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256 FROM p"""


def resampled(buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> str:
    """``op13`` with single words as features; crc32 by its table, over distinct words."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH z AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, md5(coalesce(text, '')) AS row, {words} AS words FROM documents),
e AS (SELECT rid, unnest(words) AS word FROM d),
t AS (SELECT unnest({words}) AS word FROM benchmark),
u AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM e UNION ALL SELECT word FROM t)),
b AS MATERIALIZED (SELECT word, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % {buckets} AS bucket FROM u, z),
sc AS (SELECT bucket, count(*) AS n FROM e JOIN b USING (word) GROUP BY bucket),
tc AS (SELECT bucket, count(*) AS n FROM t JOIN b USING (word) GROUP BY bucket),
al AS (SELECT coalesce((SELECT sum(n) FROM sc), 0)::DOUBLE + {buckets} AS s, coalesce((SELECT sum(n) FROM tc), 0)::DOUBLE + {buckets} AS t),
g AS MATERIALIZED (SELECT b.bucket, floor(1000 * ln((coalesce(tc.n, 0) + 1)::DOUBLE * al.s / ((coalesce(sc.n, 0) + 1)::DOUBLE * al.t)))::BIGINT AS gain
 FROM range({buckets}) b(bucket) LEFT JOIN sc ON sc.bucket = b.bucket LEFT JOIN tc ON tc.bucket = b.bucket, al),
w AS (SELECT rid, sum(gain)::BIGINT AS weight FROM e JOIN b USING (word) JOIN g USING (bucket) GROUP BY rid),
o AS (SELECT rid, doc_id, row, len(words) AS n, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (rid)),
r AS (SELECT *, row_number() OVER (ORDER BY n < {least_words}, score DESC, doc_id NULLS LAST, row) AS place, count(*) FILTER (WHERE n >= {least_words}) OVER () AS all_n FROM o)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN place <= all_n * {percent} // 100 THEN place END AS rank FROM r"""
