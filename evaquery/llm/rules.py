"""Quality rules in Spark SQL functions: counts, repetition, and distribution divergence.

A document's character-class histogram and its histogram of common words are compared
with the references of its language by Jensen-Shannon distance. References are summed
over all documents of the language that pass the base rules. Short documents, and ones
of a language without a reference, are not judged by a histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, stored

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"

#: The most common words of a language, most frequent first.
COMMON_WORDS = {
    "en": "the of and to in is it that for on with be are was by this from an at or".split(),
    "de": "der die und das ist zu den von mit nicht ein auf dem im auch des sich eine für".split(),
    "fr": "le la de et les des un une du en est pour que dans au sur par il".split(),
    "es": "el la de que y en los se del las un por con no una es para su".split(),
}
CLASSES = ("lower", "space", "upper", "stops", "digit", "other")


LONGEST = max(map(len, COMMON_WORDS.values()))


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return F.size(lines) - F.size(F.array_distinct(lines))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def _covered(starts: Column, window: int) -> Column:
    """How many positions windows at the ascending ``starts`` cover."""
    first = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(window), x - acc["last"])).alias("n"))
    return F.aggregate(starts, first, step, lambda acc: acc["n"])


def repeat_words(words: Column, window: int = 5) -> Column:
    """Words in windows of ``window`` words that occur twice or more, the first included.

    ``words`` must be a plain column. Window hashes clear the documents without any
    repeat, nearly all; in the others windows are sorted as text and neighbours compared.
    """
    starts = F.sequence(F.lit(0), F.size(words) - window)
    own = lambda i: F.slice(words, i + 1, F.lit(window))
    distinct = F.size(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(own(i)))))

    def repeated(placed: Column) -> Column:
        like = lambda x, k: F.get(placed, k)["w"] == x["w"]
        twice = F.transform(placed, lambda x, k: F.when(F.coalesce(like(x, k - 1), F.lit(False)) | F.coalesce(like(x, k + 1), F.lit(False)), x["i"]))
        return _covered(F.sort_array(F.filter(twice, lambda i: i.isNotNull())), window)

    placed = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(own(i), " ").alias("w"), i.alias("i"))))
    return F.when(F.size(words) <= window, 0).when(distinct == F.size(words) - window + 1, 0).otherwise(_bound(placed, repeated))


def _with_classes(df: DataFrame) -> DataFrame:
    """Adds ``classes``: characters of ``text`` by CLASSES. Each step looks at what is left."""
    rest = df.withColumn("left0", F.col("text"))
    for i, pattern in enumerate(("\\p{Ll}+", SPACE, "\\p{Lu}+", "[.,;:!?'\"()-]+", "[0-9]+")):
        rest = rest.withColumn(f"left{i + 1}", F.regexp_replace(f"left{i}", pattern, ""))
    n = [F.length(f"left{i}").cast("bigint") for i in range(6)] + [F.lit(0).cast("bigint")]
    return rest.withColumn("classes", F.array(*[n[i] - n[i + 1] for i in range(6)])).drop(*[f"left{i}" for i in range(6)])


def _common_counts(common: Column, language: Column, n_words: Column) -> Column:
    """Counts of the language's common words in ``common`` (each within its own blanks),
    padded to one length, and last of all other words; null for other languages."""
    counts = F.lit(None).cast("array<bigint>")
    for lang, listed in COMMON_WORDS.items():
        each = [((F.octet_length(common) - F.octet_length(F.replace(common, F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("bigint") for w in listed]
        counts = F.when(language == lang, F.array(*each, *[F.lit(0).cast("bigint")] * (LONGEST - len(listed)))).otherwise(counts)
    return F.when(counts.isNotNull(), _bound(counts, lambda c: F.concat(c, F.array(n_words - F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)))))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def divergence(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of counts; null if one is empty."""
    share = lambda x: F.transform(x, lambda v: v / _total(x))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    mixed = lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2
    return F.when((_total(a) > 0) & (_total(b) > 0), F.sqrt(F.greatest(F.lit(0.0), _total(F.zip_with(share(a), share(b), mixed)))))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", window: int = 5, least_words: int = 10, most_repeated: int = 20,
    class_words: int = 60, class_distance: float = 0.3, common_words: int = 120, common_distance: float = 0.3,
) -> DataFrame:
    """One row for each row of ``docs``: the base counts, base_failed, kept and both distances.

    base_failed: under ``least_words`` words, or over ``most_repeated`` percent of them in
    repeated windows. Otherwise a document is rejected if it has ``class_words`` words or
    more and its character classes lie over ``class_distance`` from its language's, or
    ``common_words`` or more and its common words lie over ``common_distance``. A null
    text counts as empty (base_failed); a null or unknown language is not compared; an
    empty table gives no rows. Features are computed in one pass over the texts and
    stored, a few hundred bytes a row; references are one row a listed language.
    """
    own = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"), col(lang_col).cast("string").alias("lang"))
    own = _with_classes(own.withColumn("words", words_of(F.col("text"))))
    listed = sorted({w for x in COMMON_WORDS.values() for w in x})
    own = own.withColumn("common", F.concat(F.lit(" "), F.lower(F.array_join(F.filter("words", lambda w: F.lower(w).isin(listed)), "  ")), F.lit(" ")))
    n_words = F.size("words").cast("bigint")
    features = stored(own.select(
        "doc_id", "lang", n_words.alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        duplicate_lines(F.col("text")).cast("bigint").alias("n_dup_lines"), repeat_words(F.col("words"), window).cast("bigint").alias("n_repeat_words"),
        "classes", _common_counts(F.col("common"), F.col("lang"), n_words).alias("commons"),
    ))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    features = features.withColumn("base_failed", failed)
    summed = lambda name, n: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(n)])
    good = features.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON_WORDS)))
    references = good.groupBy("lang").agg(summed("classes", len(CLASSES)).alias("ref_classes"), summed("commons", LONGEST + 1).alias("ref_commons"))
    judged = features.join(F.broadcast(references), "lang", "left")  # one row for each of the listed languages at most
    judged = judged.withColumn("class_distance", F.when(F.col("n_words") >= class_words, divergence(F.col("classes"), F.col("ref_classes"))))
    judged = judged.withColumn("common_distance", F.when(F.col("n_words") >= common_words, divergence(F.col("commons"), F.col("ref_commons"))))
    rejected = F.coalesce(F.col("class_distance") > class_distance, F.lit(False)) | F.coalesce(F.col("common_distance") > common_distance, F.lit(False))
    kept = ~F.col("base_failed") & ~rejected
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "common_distance")
