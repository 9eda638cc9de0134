"""A Merkle manifest of a table: a leaf for each row, trees of 16 children for each group, one tree over the groups' roots.

Levels are windows: the nodes of a group are partitioned by their parent's place, and one ordered list over the whole frame
(16 nodes at most) gives the parent's preimage and each node's siblings. Parents are then made distinct for the next level.
Paths go down from the root the same way, each level joined to the one above by the parent's place, so a group that holds
most rows is spread over tasks on every level; so are the places of leaves, which are counted by ranges. All of it is
DataFrame expressions.

Decisions: leaves of a group ascend by id (null first), then by their hash; so rows with equal ids have a defined order and
repeated rows are leaves of their own, with equal hashes. A null is `-` and an empty string `0:`, so they differ; a null
group is one group and comes first. Integers are decimal. A group of one leaf has that leaf as its root; a table of one
group has that group's root. An empty table gives an empty manifest. Only the named fields are hashed: extra columns neither
count nor pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

FANOUT = 16


def leaf_hash(fields: list[Column]) -> Column:
    """sha256 of the fields, one after the other: `-` for null, else byte count, `:`, value."""
    shown = [c.cast("string") for c in fields]
    shown = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in shown)), 256)


def joined_hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with i, the place in their group g by order (from 0), and n, the group's rows. No group passes through one task: each range of rows counts its own, and carries what stands before it."""
    spread = cut(rows.repartitionByRange("g", *order).withColumn("_range", F.spark_partition_id()))
    counts = spread.groupBy("g", "_range").agg(F.count(F.lit(1)).alias("_held"))
    ahead = F.sum("_held").over(Window.partitionBy("g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("g", "_range", F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_held").over(Window.partitionBy("g")).alias("n"))
    within = F.row_number().over(Window.partitionBy("g", "_range").orderBy(*order)) - 1
    return spread.withColumn("_within", within).join(counts, ["g", "_range"]).withColumn("i", F.col("_ahead") + F.col("_within")).drop("_range", "_ahead", "_within")


def _runs(nodes: DataFrame) -> DataFrame:
    """The nodes of groups with several, with p, their parent's place, and run, the hashes of all children of that parent."""
    rows = nodes.where("n > 1").withColumn("p", F.expr(f"i div {FANOUT}"))
    whole = Window.partitionBy("g", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("run", F.collect_list("h").over(whole))


def grown(leaves: DataFrame) -> list[DataFrame]:
    """The levels (g, i, n, h) from the leaves up; a group's root is its node with n = 1, on whichever level it has one."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        parents = _runs(levels[-1]).select("g", F.col("p").alias("i"), F.ceil(F.col("n") / FANOUT).alias("n"), joined_hash(F.col("run")).alias("h"))
        levels.append(cut(parents.dropDuplicates(["g", "i"])))
        most = -(-most // FANOUT)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(g, h): the root of each group."""
    found = [x.where("n = 1").select("g", "h") for x in levels]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def with_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with path, an array of (before, after): the siblings' hashes on each level from the leaf up, joined.

    tops: (g, path, ...), one row per group: the path from the group's root on, and columns that the leaves get.
    """
    carried = [c for c in tops.columns if c not in ("g", "path")]
    found = None
    for k in reversed(range(len(levels))):
        nodes = levels[k]
        own = [c for c in nodes.columns if c != "g"] if k == 0 else ["i"]
        rows = nodes.where("n = 1").join(tops, "g").select("g", *own, "path", *carried)
        if found is not None:
            at = F.pmod("i", F.lit(FANOUT)).cast("int")
            step = F.struct(F.array_join(F.slice("run", 1, at), "").alias("before"), F.array_join(F.slice("run", at + 2, FANOUT), "").alias("after"))
            below = _runs(nodes).join(found.withColumnRenamed("i", "p"), ["g", "p"])
            rows = rows.unionByName(below.select("g", *own, F.concat(F.array(step), "path").alias("path"), *carried))
        found = cut(rows) if k else rows
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", presented: dict[str, Column] | None = None) -> DataFrame:
    """(id, group, leaf, presented, path, subroot, root): one row per row of docs.

    fields are hashed in their order. presented: expressions in place of some fields, for what is to be verified against the
    manifest; the column of that name holds the leaf which they give.
    """
    given = {c: (presented or {}).get(c, F.col(c)) for c in fields}
    group = F.col(group_col).cast("string")
    # one key without nulls, in the order of the groups: null first, then by bytes
    g = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group))
    leaves = docs.select(g.alias("g"), F.col(id_col).alias("id"), leaf_hash([F.col(c) for c in fields]).alias("h"), leaf_hash(list(given.values())).alias("presented"))
    levels = grown(cut(numbered(cut(leaves), ["id", "h"])))
    # the tree over the groups: its one group is all of them
    over = grown(cut(numbered(cut(roots(levels).select(F.lit("").alias("g"), F.col("g").alias("group"), "h")), ["group"])))
    top = roots(over).select("g", F.col("h").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    tops = with_paths(over, cut(top)).select(F.col("group").alias("g"), "path", F.col("h").alias("subroot"), "root")
    found = with_paths(levels, cut(tops))
    return found.select(F.col("id").alias(id_col), F.when(F.col("g") != "", F.substr("g", F.lit(2))).alias(group_col), F.col("h").alias("leaf"), "presented", "path", "subroot", "root")


def verified(found: DataFrame) -> DataFrame:
    """A manifest with proof_sha256 (hash of all siblings, leaf to root, left to right), folded_root and verified instead of the paths."""
    proof = joined_hash(F.transform("path", lambda s: F.concat(s["before"], s["after"])))
    out = found.withColumn("proof_sha256", proof).withColumn("folded_root", folded(F.col("presented"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("presented", "path")
