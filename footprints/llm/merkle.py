"""Merkle manifest of a table: a tree of digests over the rows of each group, and one over the groups' subroots.

Each parent's children are spread into one column per slot by conditional aggregates. The columns put together give the
parent's digest; left out the own one, they are a child's siblings. So no child is joined with its siblings, and the way up
from a row is what each parent on it has at hand: joins take place between parents only, an eighth of the rows at most.

Everything is done by SQL functions. Rows are put into order by ranges of (group, key, leaf), so that a group which holds
most rows is spread over many tasks, and are numbered by their place within a range plus the counts of the ranges before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from footprints.llm.storage import small_or_not, written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# No tree of rows that a 64-bit number counts is deeper.
_DEEPEST = 22
_ID_BITS = 33


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row: each value as ``-`` if null, else its number of UTF-8 bytes, a colon and itself."""
    shown = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in fields.values()]
    return F.sha2(F.concat(*shown), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with ``at``, their place from 0 within their group, nulls first; rows equal in all these columns go in any order.

    ``at`` is the place within a range of the sorted rows plus the counts of the group's rows in earlier ranges; of those there
    is one number for each range and group that meet.
    """
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ranged = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_run", F.shiftright("_id", _ID_BITS))
    # A group that spans several ranges fills those between its first and last; the sums run over ranges, not over rows.
    runs = ranged.groupBy("_run", *group).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_run").alias("_of_run"), *[F.col(g).alias(f"_of_{g}") for g in group], (before - F.col("_first")).alias("_shift"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group], F.col("_run") == F.col("_of_run"))
    return ranged.join(small_or_not(runs), same).select(*rows.columns, (F.col("_id") + F.col("_shift")).alias("at"))


def _depth(n: Column) -> Column:
    """How often n nodes are taken together before one is left."""
    return reduce(lambda a, b: a + b, [(n > F.lit(float(FANOUT) ** k)).cast("int") for k in range(_DEEPEST)])


def _risen(nodes: DataFrame, carried: list[str], largest: int) -> list[DataFrame]:
    """The levels above nodes (tree, n, at, h, carried): parents (tree, n, at, h, c0..c7), n being the nodes left in the tree."""
    levels = []
    while largest > 1:
        kept = ["h", *carried] if not levels else ["h"]
        slot = F.col("at") % FANOUT
        spread = [F.max(F.when(slot == k, F.struct(*kept))).alias(f"c{k}") for k in range(FANOUT)]
        parents = nodes.where("n > 1").groupBy("tree", "n", F.expr(f"at div {FANOUT}").alias("at")).agg(*spread)
        parents = parents.withColumn("n", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}")).withColumn("h", F.sha2(F.concat_ws("", *[f"c{k}.h" for k in range(FANOUT)]), 256))
        nodes = written(parents, "level")
        levels.append(nodes)
        largest = -(-largest // FANOUT)
    return levels


def _children(parents: DataFrame) -> DataFrame:
    """(tree, at, child, path) of parents with their path: the own siblings, those before and those after, ahead of the parent's path."""

    def siblings(k):
        return F.struct(*[F.concat_ws("", *[f"c{j}.h" for j in places]).alias(name) for name, places in (("before", range(k)), ("after", range(k + 1, FANOUT)))])

    slots = [F.struct((F.col("at") * FANOUT + k).alias("at"), F.col(f"c{k}").alias("child"), siblings(k).alias("step")) for k in range(FANOUT)]
    each = parents.select("tree", "path", F.explode(F.array(*slots)).alias("s")).where("s.child is not null")
    return each.select("tree", F.col("s.at").alias("at"), F.col("s.child").alias("child"), F.concat(F.array("s.step"), "path").alias("path"))


def _descended(levels: list[DataFrame], roots: DataFrame) -> DataFrame | None:
    """The children of the lowest level with their paths; roots (tree, depth, path) hang above the trees. None without levels."""
    below = None
    for k in range(len(levels), 0, -1):
        paths = roots.where(F.col("depth") == k).select("tree", F.lit(0).cast("bigint").alias("at"), "path")
        if below is not None:
            paths = paths.unionByName(below.select("tree", "at", "path"))
        below = _children(levels[k - 1].join(paths, ["tree", "at"]))
    return below


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and the siblings on its way up."""
    return F.aggregate(path, start, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(path, lambda step: F.array(step["before"], step["after"])))), 256)


def proven(leaves: DataFrame) -> DataFrame:
    """leaves (group, key, leaf, and more) with subroot, root and path: an array of (before, after), the siblings of each level.

    Within a group, rows ascend by key, nulls first, then by leaf; rows equal in both are equal to the trees. Groups ascend,
    null first. A group of one row has its leaf as subroot; a table of one group has its subroot as root. An empty table gives
    an empty result. The root is the one value that reaches the driver, besides counts.
    """
    carried = [c for c in leaves.columns if c not in ("group", "leaf")]
    placed = written(numbered(leaves, ["group"], ["key", "leaf"]), "placed")
    groups = numbered(placed.groupBy("group").agg(F.count("*").alias("n")), [], ["group"]).withColumnRenamed("at", "tree")
    groups = written(groups, "groups")
    sizes = groups.agg(F.max("n"), F.count("*")).first()
    largest, trees = sizes[0] or 0, sizes[1]
    numbers = small_or_not(groups.select(F.col("group").alias("_group"), "tree", "n"))
    nodes = placed.join(numbers, F.col("group").eqNullSafe(F.col("_group"))).select("tree", "n", "at", F.col("leaf").alias("h"), "group", *carried)
    levels = _risen(nodes, ["group", *carried], largest)

    alone = nodes.where("n = 1").select("tree", "h")
    subroots = reduce(DataFrame.unionByName, [level.where("n = 1").select("tree", "h") for level in levels], alone)
    upper = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.lit(trees).cast("bigint").alias("n"), F.col("tree").alias("at"), "h")
    upper = written(upper, "subroots")
    above = _risen(upper, ["at"], trees)
    top = (above[-1] if above else upper).select("h").first()
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    top_path = F.broadcast(upper.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("tree"), F.lit(len(above)).alias("depth"), nothing.alias("path")))
    hung = _descended(above, top_path)
    if hung is None:
        hung = upper.select(F.col("at").alias("tree"), F.col("h").alias("subroot"), nothing.alias("path"))
    else:
        hung = hung.select(F.col("at").alias("tree"), F.col("child.h").alias("subroot"), "path")
    hung = small_or_not(written(hung.join(groups.select("tree", _depth(F.col("n")).alias("depth")), "tree"), "hung"))

    found = nodes.where("n = 1").join(hung, "tree").select("group", *carried, F.col("h").alias("leaf"), "subroot", "path")
    low = _descended(levels, hung.select("tree", "depth", "path"))
    if low is not None:
        low = low.join(hung.select("tree", "subroot"), "tree")
        found = found.unionByName(low.select("child.group", *[f"child.{c}" for c in carried], F.col("child.h").alias("leaf"), "subroot", "path"))
    return found.withColumn("root", F.lit(top[0] if top else None).cast("string"))


def manifest(docs: DataFrame, tampered: Column | None = None, altered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, path, proof_sha256, folded_root and verified of every row of documents.

    The trees are those of the rows as they are. folded_root is worked out anew from the path and, where ``tampered`` holds,
    from the row with the ``altered`` values in the place of its own; verified tells whether it is the root. Null values count
    as ``-``, empty texts as ``0:``; a null id comes first in its language. Repeated rows stand side by side, each with its
    own proof. Texts of any length are hashed whole, once or (where altered) twice. Columns besides FIELDS play no part.
    """
    own = {f: F.col(f) for f in FIELDS}
    other = F.when(tampered, leaf(own | (altered or {}))) if tampered is not None else F.lit(None).cast("string")
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"), leaf(own).alias("leaf"), other.alias("other"))
    found = proven(written(leaves, "leaves"))
    found = found.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return found.select(
        F.col("key").alias("doc_id"), F.col("group").alias("lang"), "leaf", "subroot", "root", "path", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def lowered(column: str = "text") -> dict[str, Column]:
    """The alteration that only lower-cases A-Z."""
    return {column: F.translate(column, UPPER, LOWER)}
