"""Near duplicates by the exact Jaccard similarity of word shingles: the SimHash index links first, a prefix filter completes.

Equal sets of shingles are one node. Nodes whose fingerprints the Gray-order index links are compared first, which joins
most of each group of copies. Fingerprints alone can't do it: two sets at 0.8 differ in about 10 of 64 bits. So the nodes
that are in different groups still are held against each other where they may be similar: in any one order of shingles,
two similar sets share several of the first few of each (its prefix), while unlike sets that happen to share a shingle
mostly share that one only: pairs are counted by shingle, and texts are fetched for those alone that share enough. Shingles
that are common in a sample come last in the order, which keeps them out of most prefixes; the result doesn't depend on the sample.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import simhash
from tidemark.llm.common import components, cut, in_slices, shuffles_freed

#: Documents of the sample, and shingles of it that are kept as common.
SAMPLE_DOCS, COMMON = 20000, 200000
#: Bits that the fingerprints of the first pairs differ in at most.
MOST = 8
#: Shingles of their prefixes that two similar sets share at least, if they share so many at all.
SHARED = 2
#: Hashes that a worker holds of texts compared lately, in each of two generations; a text counts for 32 more.
HELD = 2_000_000


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(simhash.shingle_hashes(text, width))


def _digest(h: np.ndarray) -> int:
    return xxh64_intdigest(h.tobytes(), 1)


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, least: float, common: np.ndarray) -> DataFrame:
    """(id, t: hash of the text, key: digest of the set, n: its size, fp, prefix: the first shingles in order)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON numbers

    def run(batches):
        late = shared.value
        for b in (x.slice(at, 256) for x in batches for at in range(0, x.num_rows, 256)):
            keys, fps, sizes, prefixes = [], [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                h = shingles(t or b"", width)
                n = len(h)
                keys.append(_digest(h))
                fps.append(simhash.majority(h))
                sizes.append(n)
                last = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h if len(late) else np.zeros(n, bool)
                first = n - math.ceil(least * n - 1e-6) + SHARED if n else 0
                prefixes.append(np.r_[h[~last], h[last]][:first].view(np.int64))
            at = np.r_[0, np.cumsum([len(x) for x in prefixes])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            signed = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, fps))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *signed, pa.array(np.array(sizes, np.int64)), lists], ["id", "t", "key", "fp", "n", "prefix"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), text_col)
    long = F.lit(0).cast("long")
    return rows.mapInArrow(run, rows.select("id", "t", long.alias("key"), long.alias("fp"), long.alias("n"), F.array().cast("array<long>").alias("prefix")).schema)


def _common(docs: DataFrame, id_col: str, text_col: str, width: int) -> np.ndarray:
    """The commonest shingles (three documents or more) of the documents with the smallest id hashes, sorted."""

    def run(batches):
        for b in in_slices(batches):
            for t in b.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t or b"", width).view(np.int64))], ["h"])

    ids = docs.select(F.xxhash64(id_col).alias("x")).orderBy("x").limit(SAMPLE_DOCS).agg(F.max("x")).first()[0]
    if ids is None:
        return np.zeros(0, np.uint64)
    sample = docs.where(F.xxhash64(id_col) <= ids).select(text_col).mapInArrow(run, "h long")
    top = sample.groupBy("h").count().where("count >= 3").orderBy(F.desc("count"), "h").limit(COMMON).select("h").toArrow()
    return np.sort(top.column("h").to_numpy().view(np.uint64))


def _needed(a: Column, b: Column, least: float) -> Column:
    """What similar sets of sizes a and b share at least; exact for sizes below 2 ** 40."""
    return F.ceil(F.lit(least) * (a + b) / F.lit(1 + least) - F.lit(1e-6))


def _may_be(a: Column, b: Column, left_a: Column, left_b: Column, least: float) -> Column:
    """Whether a shingle that leaves left_a and left_b from here on can be among the first SHARED that similar sets of sizes a and b share."""
    need = _needed(a, b, least)
    return (F.least(a, b) >= need) & (F.least(left_a, left_b) >= need - (SHARED - 1))


def _often(met: DataFrame, a: str, b: str, least: float, times: int) -> DataFrame:
    """Pairs (a, b), the smaller key and the larger, that met holds so many times, or as often as they must if sets are small. met: a row for each pair and shingle."""
    need = F.least(F.lit(times), _needed(F.col(f"{a}n"), F.col(f"{b}n"), least)).alias("need")
    pairs = met.select(F.least(f"{a}key", f"{b}key").alias("a"), F.greatest(f"{a}key", f"{b}key").alias("b"), need)
    return pairs.groupBy("a", "b", "need").count().where("count >= need").select("a", "b")


def _neighbours(met: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that follow each other by size among the holders of two shingles at least, the nearest and the next but one."""
    order = Window.partitionBy("h").orderBy("n", "key")
    before = F.array(*(F.struct(*(F.lag(c, k).over(order).alias(c) for c in ("key", "n", "at"))) for k in (1, 2)))
    rows = met.withColumn("before", before).select("key", "n", "at", F.explode("before").alias("x")).where("x.key is not null")
    rows = rows.where(_may_be(F.col("n"), F.col("x.n"), F.col("n") - F.col("at"), F.col("x.n") - F.col("x.at"), least))
    return _often(rows, "", "x.", least, 2)


def _by_group(met: DataFrame, linked: DataFrame) -> DataFrame:
    """The holders of those shingles that several groups hold, each with its group (root) and whether that isn't the shingle's largest (minor)."""
    rows = cut(met.join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    largest = rows.groupBy("h", "root").count().groupBy("h").agg(F.max_by("root", F.struct("count", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("h", "top")
    return cut(rows.join(largest, "h").withColumn("minor", F.col("root") != F.col("top")))


def _nearest(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of each minor holder with those of the largest group that are next to it by size, for two shingles at least.

    They join most of what belongs to a large group before all that is still apart meets.
    """
    member = F.when(~F.col("minor"), F.struct("key", "n", "at"))
    up, down = Window.partitionBy("h").orderBy("n", "key"), Window.partitionBy("h").orderBy(F.desc("n"), F.desc("key"))
    sides = F.array(*(F.last(member, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for w in (up, down)))
    found = rows.withColumn("sides", sides).where("minor").select("key", "n", "at", F.explode("sides").alias("x")).where("x.key is not null")
    found = found.where(_may_be(F.col("n"), F.col("x.n"), F.col("n") - F.col("at"), F.col("x.n") - F.col("x.at"), least))
    return _often(found, "", "x.", least, 2)


def _apart(rows: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) that share SHARED shingles of their prefixes and may be similar, but are in different groups yet.

    Each shingle that two such sets share is held by several groups, so all are here to be counted.

    Of the holders of a shingle those of its largest group don't meet each other: a join of the others with all.
    """
    x, y = rows.where("minor").alias("x"), rows.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & (~F.col("y.minor") | (F.col("x.key") < F.col("y.key")))
    apart &= _may_be(F.col("x.n"), F.col("y.n"), F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"), least)
    return _often(x.join(y, (F.col("x.h") == F.col("y.h")) & apart), "x.", "y.", least, SHARED)


def _similar(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar. texts: (key, text), one row per key."""

    def run(batches):
        new, old, size = {}, {}, 0  # key -> hashes

        def held(keys, texts, k):
            nonlocal new, old, size
            if (h := new.get(key := keys[k])) is None:
                if (h := old.get(key)) is None:
                    h = shingles(texts[k].as_py() or b"", width)
                if size > HELD:
                    new, old, size = {}, new, 0
                new[key] = h
                size += len(h) + 32
            return h

        for b in batches:
            a_keys, b_keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            x, y = (b.column(c).cast(pa.binary()) for c in (2, 3))
            ok = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                g, h = held(a_keys, x, k), held(b_keys, y, k)
                need = math.ceil(least * (len(g) + len(h)) / (1 + least) - 1e-6)
                ok[k] = min(len(g), len(h)) >= need and len(np.intersect1d(g, h, assume_unique=True)) >= need
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    pairs = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _members(docs: DataFrame, id_col: str, text_col: str, width: int, least: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, t, key, root) of each row, and (root, component_id)."""
    sets = cut(_sets(docs, id_col, text_col, width, least, _common(docs, id_col, text_col, width)))
    nodes = cut(sets.groupBy("key").agg(F.min(F.struct("t", "id")).alias("one"), F.first("fp").alias("fp")))
    # of shingles in prefixes those that two sets have, in one exchange: rows (h, key, size and place in one number)
    met = sets.groupBy("key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).select("key", "n", F.posexplode("prefix").alias("at", "h"))
    met = met.select("h", "key", (F.shiftleft("n", 31) + F.col("at")).alias("place")).withColumn("holders", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("holders > 1")
    met = cut(met.select("h", "key", F.shiftright("place", 31).alias("n"), F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).alias("at")))

    def texts(pairs: DataFrame) -> DataFrame:
        """(key, text) of each key in pairs, from one of the rows that have it."""
        wanted = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key").select("key", "one.t", F.col("one.id").alias("id"))
        held = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
        found = held.join(wanted, (held["t"] == wanted["t"]) & F.col("i").eqNullSafe(F.col("id"))).select("key", "text")
        return cut(found.dropDuplicates(["key"]))

    first = nodes.groupBy("fp").agg(F.min("key").alias("key"))
    near = simhash.links(cut(first.select("fp")), most)
    near = near.join(first.select(F.col("fp").alias("a"), F.col("key").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("key").alias("y")), "b")
    same = nodes.join(first.withColumnRenamed("key", "x"), "fp").where("key <> x").select("x", F.col("key").alias("y"))
    asked = cut(near.select("x", "y").unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    links = cut(_similar(asked, texts(asked), width, least))
    linked = None
    for more in (None, _nearest, _apart):
        pairs = cut((more(_by_group(met, linked), least) if more else _neighbours(met, least)).join(asked, ["a", "b"], "left_anti"))
        asked = asked.unionByName(pairs)
        links = links.unionByName(cut(_similar(pairs, texts(pairs), width, least)))
        linked = components(links)
        links = linked.select(F.col("node").alias("a"), F.col("root").alias("b"))  # the same groups by fewer links
    member = sets.select("id", "t", "key").join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least_id = cut(member.groupBy("root").agg(F.min("id").alias("component_id")))
    return member, least_id


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, most: int = MOST) -> DataFrame:
    """(id, t, root, component_id): one row per row of docs; root tells its group, that is all rows reachable over pairs of
    Jaccard similarity least or more, component_id is the smallest id in it, and t is the text's xxhash64.

    A null text is an empty one, and texts without words are one node. Null ids never name a group unless all ids in it
    are null. Rows with equal ids or texts each keep their row; an empty table gives an empty one.
    """
    with shuffles_freed(docs.sparkSession):
        member, least_id = _members(docs, id_col, text_col, width, least, most)
    return member.join(least_id, "root").select(F.col("id").alias(id_col), "t", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """Of each group one row stays, with all columns: that with the smallest id (null ids last), of these the smallest text hash.

    Rows with equal ids and texts are in one group, so one of them stays. Columns of docs pass through; one named _near_t raises.
    """
    if "_near_t" in docs.columns:
        raise ValueError("docs has a column _near_t already")
    groups = near_duplicates(docs, id_col, text_col, width, least)
    own = F.struct(F.xxhash64(text_col).alias("t"), F.col(id_col).alias("id"))  # null ids are equal in a struct, and join and duplicates share one exchange
    with shuffles_freed(docs.sparkSession):
        keep = groups.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "t")).alias("k"))
        keep = cut(keep.select(F.struct(F.coalesce("k.t", F.lit(0).cast("long")).alias("t"), "k.id").alias("_near_t")))  # t is never null, here as there
    return docs.withColumn("_near_t", own).join(keep, "_near_t", "left_semi").dropDuplicates(["_near_t"]).drop("_near_t")
