"""Line dedup by a log-template tree, in Spark SQL functions.

Lines are parsed as log messages are: routed by their number of tokens and their
leading tokens to a leaf of a tree of fixed depth. Variable fields become a wildcard in
two ways: tokens that hold a digit, an @ or :// always do, and within a leaf, lines that
agree on most tokens are of one template, and so is what such lines connect. Further
lines only ever add to a template. One that occurs in different documents is recurring;
its first line stays and all others are dropped.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, small, stored
from .graph import connected_components
from .rules import SPACE, SPACES

VARIABLE = "(?<!\\S)(?=\\S*?(?:[0-9@]|://))\\S+"
WILDCARD = "<*>"
#: The templates of a key of the tree are compared in one row up to this number.
ROW_GROUP = 32
#: Templates in a chunk of a larger key, two of which are compared in one row.
TILE = 128


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _occurrences(text: Column, of: str) -> Column:
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(of), F.lit("")))) / len(of)).cast("int")


def masked_lines(keyed: DataFrame, depth: int) -> DataFrame:
    """(id, row, pos, tokens, n, constant, leaf, template): the lines, their variable tokens as wildcards.

    leaf is the path through the tree, token count then leading tokens; constant counts
    the tokens that are no wildcard. Lines are rewritten only if they hold what there is
    to rewrite.
    """
    bare = keyed.select("id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("id", "row", "pos", F.trim("line", F.lit(SPACES)).alias("bare"))
    uneven = F.contains("bare", F.lit("  ")) | reduce(or_, [F.contains("bare", F.lit(c)) for c in SPACES if c not in " \n"])
    plain = bare.select("id", "row", "pos", F.when(uneven, F.regexp_replace("bare", SPACE, " ")).otherwise(F.col("bare")).alias("plain"))
    fields = F.col("plain").rlike("[0-9@:]")
    masked = plain.select("id", "row", "pos", F.when(fields, F.regexp_replace("plain", VARIABLE, WILDCARD)).otherwise(F.col("plain")).alias("masked"))
    cut = masked.select("id", "row", "pos", "masked", F.split("masked", " ").alias("tokens"))
    constant = (F.size("tokens") - _occurrences(F.col("masked"), WILDCARD)).alias("constant")
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf")
    return cut.select("id", "row", "pos", "tokens", F.size("tokens").alias("n"), constant, leaf, _digest(F.col("masked")).alias("template"))


def counted(lines: DataFrame, least_tokens: int) -> DataFrame:
    """The lines that are compared: ``least_tokens`` tokens or more, not all of them wildcards."""
    return lines.where((F.col("n") >= least_tokens) & (F.col("constant") > 0))


def _alike(a: Column, b: Column, edits: Column) -> Column:
    """Whether two token arrays of one length differ in at most ``edits`` places."""
    unlike = F.zip_with(a, b, lambda x, y: (x != y).cast("int"))
    return F.aggregate(unlike, F.lit(0), lambda n, x: n + x) <= edits


def _branches(members: DataFrame) -> DataFrame:
    """The members, once for each branch below their key (parent): the places that are still
    open are cut into one piece more than may differ, and a branch fixes the tokens of one.

    Two alike templates of a key share a branch, since one piece holds none of their
    differences. Where no more places are open than may differ, all of a key are alike.
    """
    size = F.size("open")
    at = lambda i: F.floor(size * i / (F.col("edits") + 1)).cast("int")
    piece = lambda i: F.slice("open", at(i) + 1, at(i + 1) - at(i))
    fixed = lambda i: F.struct(F.xxhash64("key", i, F.transform(piece(i), lambda p: F.get("tokens", p))).alias("key"), F.array_except("open", piece(i)).alias("open"))
    return members.select(F.col("key").alias("parent"), "template", "tokens", "edits", F.inline(F.transform(F.sequence(F.lit(0), F.col("edits")), fixed)))


def _linked(groups: DataFrame) -> DataFrame:
    """(a, b): links that connect the alike members of each small group, each to the least it is connected to.

    ``label`` is what a member is known to be connected to; members of one label are not compared.
    """
    own = groups.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("template", "tokens", "edits", "label"))).alias("all"))
    put = lambda f, to: F.struct(f["template"].alias("template"), f["tokens"].alias("tokens"), f["edits"].alias("edits"), to.alias("label"))

    def joined(done: Column, t: Column) -> Column:
        met = F.transform(F.filter(done, lambda f: (f["label"] != t["label"]) & _alike(f["tokens"], t["tokens"], t["edits"])), lambda f: f["label"])
        labels = F.array_distinct(F.concat(F.array(t["label"]), met))

        def relabelled(at: Column) -> Column:
            to = lambda f: F.when(F.array_contains(at["labels"], f["label"]), at["least"]).otherwise(f["label"])
            return F.concat(F.when(F.size(at["labels"]) > 1, F.transform(done, lambda f: put(f, to(f)))).otherwise(done), F.array(put(t, at["least"])))

        # each is bound by a transform of one element: an expression that a lambda names is worked out for every element it runs over
        bound = F.transform(F.array(labels), lambda found: F.struct(found.alias("labels"), F.array_min(found).alias("least")))
        return F.transform(bound, relabelled)[0]

    ends = own.select(F.inline_outer(F.aggregate("all", F.slice("all", 1, 0), joined)))
    return ends.where("label <> template").select(F.col("template").alias("a"), F.col("label").alias("b"))


def _in_tiles(groups: DataFrame) -> DataFrame:
    """The members of groups of ``n``, ``rest`` of which are not alike their ``least``, cut into chunks of TILE and dealt so
    that any two meet in a tile, which is the new key, but for two that are alike the least: these are connected."""
    chunks = lambda n: F.ceil(n / TILE).cast("bigint")
    own = groups.withColumns({"rests": chunks(F.col("rest")), "likes": chunks(F.col("n") - F.col("rest"))})
    own = own.withColumn("chunk", F.pmod(F.xxhash64("template"), F.when(F.col("alike"), F.col("likes")).otherwise(F.col("rests"))))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    within = F.transform(upto(F.col("rests")), lambda i: F.xxhash64("key", F.least("chunk", i), F.greatest("chunk", i)))
    across = lambda rest, like: F.xxhash64("key", rest, F.lit("like"), like)
    of_like, of_rest = F.transform(upto(F.col("rests")), lambda i: across(i, F.col("chunk"))), F.transform(upto(F.col("likes")), lambda i: across(F.col("chunk"), i))
    label = F.when(F.col("alike"), F.col("least")).otherwise(F.col("template")).alias("label")
    return own.select("template", "tokens", "edits", label, F.explode(F.when(F.col("alike"), of_like).otherwise(F.concat(within, of_rest))).alias("key"))


def template_links(tokens: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(a, b): links between template digests that connect all that are alike in a leaf.

    ``tokens`` has a row (leaf, template, tokens) for each template of a mixed leaf; two
    are alike if they agree on ``similarity`` of their tokens. Up to ROW_GROUP templates of
    a key, at first the leaf, are compared in one row. In a larger key all are compared
    with the least; the rest that is unlike it is, up to ROW_GROUP of them, compared with
    all. With a larger rest the tree goes on in branches (see ``_branches``) if these hold
    fewer pairs than the key has to compare, and else the key is compared in tiles of bounded rows.
    """
    spare = F.floor((1 - similarity) * F.size("tokens") + 1e-9).cast("int")
    members = tokens.select("template", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"), spare.alias("edits"), F.col("leaf").alias("key"))
    places = F.when(F.size("tokens") > depth, F.sequence(F.lit(depth), F.size("tokens") - 1)).otherwise(F.array().cast("array<int>"))
    members = stored(members.where("edits > 0").withColumn("open", places))
    links = None
    while True:
        sizes = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("template").alias("least")).where("n > 1"))
        kept = members.join(small(sizes), "key")
        found = _linked(kept.where(F.col("n") <= ROW_GROUP).withColumn("label", F.col("template")))
        links = found if links is None else links.unionByName(found)
        if sizes.where(F.col("n") > ROW_GROUP).isEmpty():
            return links
        large = stored(kept.where(F.col("n") > ROW_GROUP))
        least = stored(large.where("template = least").select("key", F.col("tokens").alias("least_tokens")))
        met = stored(large.join(small(least, width=8 * F.size("least_tokens") + 40), "key").withColumn("alike", _alike(F.col("tokens"), F.col("least_tokens"), F.col("edits"))).drop("least_tokens"))
        links = links.unionByName(met.where("alike and template <> least").select(F.col("template").alias("a"), F.col("least").alias("b")))
        rests = stored(met.where("not alike").groupBy("key").agg(F.count(F.lit(1)).alias("rest")))
        few = met.where("not alike").join(small(rests.where(F.col("rest") <= ROW_GROUP)), "key").groupBy("key").agg(F.collect_list(F.struct("template", "tokens")).alias("others"))
        close = F.filter("others", lambda o: (o["template"] != F.col("template")) & _alike(o["tokens"], F.col("tokens"), F.col("edits")))
        links = links.unionByName(met.join(small(stored(few), width=F.size("others") * (8 * F.size(F.col("others")[0]["tokens"]) + 40)), "key").select("template", F.explode_outer(close).alias("o")).where("o is not null").select(F.col("template").alias("a"), F.col("o.template").alias("b")))
        many = met.join(small(rests.where(F.col("rest") > ROW_GROUP)), "key")
        if many.isEmpty():
            return links
        many = stored(many)
        below = stored(_branches(many))
        pairs = F.col("rest").cast("double") * (2 * F.col("n") - F.col("rest"))
        children = below.groupBy("parent", "key").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("parent").alias("key")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
        worth = stored(many.groupBy("key").agg(F.first(pairs).alias("left")).join(children, "key").select("key", (F.col("pairs") < F.col("left")).alias("worth")))
        links = links.unionByName(_linked(_in_tiles(many.join(small(worth.where("not worth")), "key"))))
        members = stored(below.join(small(worth.where("worth").select(F.col("key").alias("parent"))), "parent", "left_semi").drop("parent"))


def recurring_lines(docs: DataFrame, id_col: str, text_col: str, depth: int, least_tokens: int, similarity: float) -> DataFrame:
    """(id, row, drop array<int>): line numbers to drop, for the documents that have any.

    Only leaves that hold different templates are read a second time, with their tokens.
    What is joined with all lines, templates of families and recurring ones, is broadcast
    if counted small; beyond, its rows are stored before the join, so hot keys can be split.
    Lines are filtered after what is stored or aggregated: before, the filter would be
    pushed down and every line be rewritten once more for it.
    """
    keyed = docs.select(col(id_col).cast("bigint").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    lines = counted(stored(masked_lines(keyed, depth).drop("tokens")), least_tokens)
    mixed = stored(lines.groupBy("leaf").agg(F.min("template").alias("a"), F.max("template").alias("b")).where("a <> b").select("leaf"))
    again = masked_lines(keyed, depth).join(small(mixed), "leaf", "left_semi")
    tokens = counted(again.groupBy("leaf", "template").agg(*[F.first(c).alias(c) for c in ("tokens", "n", "constant")]), least_tokens)
    families = connected_components(template_links(tokens, depth, similarity)).where("node <> root").select(F.col("node").alias("template"), F.col("root").alias("key"))
    place = F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col("row"), F.col("pos"))
    thin = lines.join(small(stored(families)), "template", "left").select("id", "row", "pos", F.coalesce("key", "template").alias("key"))
    found = thin.groupBy("key").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min(place).alias("first")).where("a <> b").select("key", "first")
    extra = thin.join(small(stored(found)), "key").where(place != F.col("first"))
    return extra.groupBy("id", "row").agg(F.collect_set("pos").alias("drop"))


def _with_drops(docs: DataFrame, id_col: str, text_col: str, depth: int, least_tokens: int, similarity: float) -> tuple[DataFrame, Column]:
    """``docs`` with further columns, and the one that has, for each row, the numbers of the lines to drop (null: none)."""
    drops = recurring_lines(docs, id_col, text_col, depth, least_tokens, similarity)
    own_id, own_row, drop = (free_name(docs, c) for c in ("drop_id", "drop_row", "drop_lines"))
    drops = drops.select(F.col("id").alias(own_id), F.col("row").alias(own_row), F.col("drop").alias(drop))
    row = F.xxhash64(F.coalesce(col(text_col), F.lit("")))
    return docs.join(drops.hint("shuffle_hash"), col(id_col).cast("bigint").eqNullSafe(col(own_id)) & (row == col(own_row)), "left"), col(drop)


def _cleaned(text: Column, drop: Column) -> Column:
    kept = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), drop), lambda i: F.get(x, i)), "\n")
    return F.when(drop.isNull(), text).otherwise(F.transform(F.array(F.split(text, "\n")), kept)[0])


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, least_tokens: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, their texts without recurring template lines.

    A line counts from ``least_tokens`` tokens on, wildcards included, unless all are wildcards. A template recurs if it occurs in two
    different texts; exact copies of a document are one text, so they lose no line to
    each other and are left to near-duplicate removal. Of a recurring template the line
    with the least (doc_id, text hash, line number) stays, null ids last, and every
    other is dropped, in hot templates as in rare ones. Texts change by whole lines only;
    a null text stays null and a text may become empty; repeated rows are treated alike;
    an empty table gives no rows.
    """
    joined, drop = _with_drops(docs, id_col, text_col, depth, least_tokens, similarity)
    return joined.select(*[_cleaned(col(text_col), drop).alias(c) if c == text_col else col(c) for c in docs.columns])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, least_tokens: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): ``without_recurring_lines`` with line counts; a null text counts no line."""
    own = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text"))
    joined, drop = _with_drops(own, "doc_id", "text", depth, least_tokens, similarity)
    lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint")
    dropped = F.when(drop.isNull(), 0).otherwise(F.size(drop)).cast("bigint")
    return joined.select("doc_id", lines.alias("n_lines"), dropped.alias("n_dropped"), _cleaned(F.col("text"), drop).alias("text"))
