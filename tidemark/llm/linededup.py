"""Removes passages of lines that stand elsewhere already: every passage of two lines or more, or of one long line.

Texts are cut into content-defined chunks: a line begins one where the rolling hash over the hashes of the lines before it
says so, so boundaries move with the text. Chunks of two lines or more are looked up in all of the table; those that stood
earlier go, and nothing inside them is looked at again. What chunks can't give are the borders of a passage, which share a
chunk with foreign lines, and passages too short to hold a whole chunk. The complement finds these among what chunks left:
pairs of lines that follow each other (blank lines between them belong to the pair), and lines of long_line_words words.
What repeats is compared with its first occurrence byte by byte. All of it is DataFrame expressions.

Decisions: the first occurrence, by (id, hash of the text, place), stays, and what shares a line with its own first
occurrence is no copy of it ("a", "a", "a" stays). Rows with equal id and text count as one occurrence and get equal
results. Null and empty texts stay as they are. A null id sorts first. Extra columns pass through. Blank lines alone are no
passage; a text that keeps only blank lines loses them too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

_ID, _TEXT, _KEY = "_ld_id", "_ld_text", "_ld_key"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\S+"))


def _places(lines: Column) -> Column:
    """The places (from 0) of lines that aren't blank."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"\S"), i)), lambda i: i.isNotNull())


def _starts(h: Column, at: Column, window: int, divisor: int) -> Column:
    """Which of the lines at the places at begin a chunk (numbers from 0): the first, and where the hash over the window lines before says so. h: the lines' hashes."""
    rolled = lambda k: F.xxhash64(*(F.get(h, F.get(at, k - j)) for j in range(window, 0, -1)))
    return F.filter(F.transform(at, lambda i, k: F.when((k == 0) | (F.pmod(rolled(k), F.lit(divisor)) == 0), k)), lambda k: k.isNotNull())


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(x))


def chunks(text: Column, window: int = 2, divisor: int = 2) -> Column:
    """An array of (first: place of the first line, n: number of lines, text) for a text that isn't null. Blank lines end the chunk before them."""

    def cut_up(lines: Column) -> Column:
        def of(begin: Column) -> Column:
            return F.transform(begin, lambda s, k: let(F.coalesce(F.get(begin, k + 1), F.size(lines)) - s, lambda n: F.struct(s.alias("first"), n.alias("n"), F.array_join(F.slice(lines, s + 1, n), "\n").alias("text"))))

        def placed(at: Column) -> Column:
            later = F.filter(_starts(_hashes(lines), at, window, divisor), lambda k: k > 0)
            return let(F.concat(F.array(F.lit(0)), F.transform(later, lambda k: F.get(at, k))), of)

        return let(_places(lines), placed)

    return let(F.split(text, "\n", -1), cut_up)


def _units(text: Column, window: int, divisor: int, long_line_words: int) -> Column:
    """An array of (first: place of the first line, n: number of lines, chunk, whole, h1, h2: hashes) for a text that isn't null.

    whole: a chunk of two lines or more, without blank lines at its ends. Others are pairs and long lines, and chunk is the
    first place of the chunk that holds all of them, null if none of two lines or more does.
    """

    def of(lines: Column) -> Column:
        def hashed(h: Column, o: Column, at: Column) -> Column:
            def unit(a: Column, b: Column, chunk: Column, whole: bool) -> Column:
                return F.struct(F.get(at, a).alias("first"), (F.get(at, b) - F.get(at, a) + 1).alias("n"), chunk.alias("chunk"), F.lit(whole).alias("whole"))

            def long_line(k: Column) -> Column:
                return let(F.get(lines, F.get(at, k)), lambda x: F.when(F.length(x) >= 2 * long_line_words - 1, _words(x) >= long_line_words).otherwise(False))

            def within(a: Column, b: Column) -> Column:
                """The units of the chunk from the a-th line to the b-th, and the pair that leaves it."""
                chunk, ks = F.when(b > a, F.get(at, a)), F.sequence(a, b)
                alone = F.filter(F.array(unit(a, b, chunk, True)), lambda _: b > a)
                pairs = F.transform(F.filter(ks, lambda k: k + 1 < F.size(at)), lambda k: unit(k, k + 1, F.when(k < b, chunk), False))
                ones = F.transform(F.filter(ks, long_line), lambda k: unit(k, k, chunk, False))
                return F.concat(alone, pairs, ones)

            def cut_up(starts: Column) -> Column:
                return F.flatten(F.transform(starts, lambda a, j: let(F.coalesce(F.get(starts, j + 1), F.size(at)) - 1, lambda b: within(a, b))))

            units = let(_starts(h, at, window, divisor), cut_up)
            # the second hash is over other bits than the first, not over the first
            both = lambda u: (F.xxhash64(F.slice(h, u["first"] + 1, u["n"])).alias("h1"), F.hash(F.slice(o, u["first"] + 1, u["n"])).alias("h2"))
            return F.transform(units, lambda u: F.struct(*(u[c].alias(c) for c in ("first", "n", "chunk", "whole")), *both(u)))

        parts = F.struct(_hashes(lines).alias("h"), F.transform(lines, lambda x: F.hash(x)).alias("o"), _places(lines).alias("at"))
        return let(parts, lambda p: hashed(p["h"], p["o"], p["at"]))

    return let(F.split(text, "\n", -1), of)


def _runs(rows: DataFrame) -> DataFrame:
    """rows (id, key, start, end, ...) with run: one number for rows of a text that overlap or touch; covered: whether earlier rows hold all of the row."""
    order = Window.partitionBy(_ID, _KEY).orderBy("start", F.desc("end"))
    rows = rows.withColumn("upto", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("start") <= F.col("upto"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("covered", F.coalesce(F.col("end") <= F.col("upto"), F.lit(False))).drop("upto")


def _repeats(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(origins: whole, h1, h2, origin; hits: _ld_id, _ld_key, start, end, whole, h1, h2) of units that stand somewhere twice.

    A group's rows are counted before they are shuffled; only its first occurrence meets its rows again.
    """
    groups = units.groupBy("whole", "h1", "h2").agg(F.min("at").alias("origin"), F.max("at").alias("last")).where(~F.col("origin").eqNullSafe(F.col("last")))
    groups = cut(groups.select("whole", "h1", "h2", "origin"))
    own = F.col(f"at.{_ID}").eqNullSafe(F.col(f"origin.{_ID}")) & (F.col(f"at.{_KEY}") == F.col(f"origin.{_KEY}")) & (F.col("at.first") < F.col("origin.first") + F.col("origin.n"))
    hits = units.join(groups, ["whole", "h1", "h2"]).where(~own)
    return groups, hits.select(f"at.{_ID}", f"at.{_KEY}", F.col("at.first").alias("start"), (F.col("at.first") + F.col("at.n")).alias("end"), "whole", "h1", "h2").distinct()


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 2, long_line_words: int = 50) -> DataFrame:
    """(_ld_id, _ld_key, start, end, whole): what stood earlier, by places of lines from 0, end excluded; whole: found as a chunk, not by the complement."""
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias(_ID), F.xxhash64(id_col, text_col).alias(_KEY), F.col(text_col).alias(_TEXT))
    units = keyed.select(_ID, _KEY, F.inline(_units(F.col(_TEXT), window, divisor, long_line_words)))
    units = cut(units.select(F.struct(_ID, _KEY, "first", "n").alias("at"), "chunk", "whole", "h1", "h2"))
    origins, found = _repeats(units.where("whole"))
    found = cut(found)
    # what lies in a repeated chunk is done: its first occurrence holds the same pairs
    inside = F.col(f"at.{_ID}").eqNullSafe(F.col(_ID)) & (F.col(f"at.{_KEY}") == F.col(_KEY)) & (F.col("chunk") == F.col("start"))
    others = units.where("not whole")
    left = others.where("chunk is null").unionByName(others.where("chunk is not null").join(found, inside, "left_anti"))
    more_origins, more = _repeats(left)
    groups = origins.unionByName(more_origins)
    hits = cut(_runs(found.unionByName(more)).where("not covered").select(_ID, _KEY, "start", "end", "whole", "h1", "h2"))
    first = groups.join(hits.select("whole", "h1", "h2").distinct(), ["whole", "h1", "h2"])
    first = first.select(f"origin.{_ID}", f"origin.{_KEY}", F.col("origin.first").alias("start"), (F.col("origin.first") + F.col("origin.n")).alias("end"), "whole", "h1", "h2", F.lit(True).alias("origin"))
    marks = hits.withColumn("origin", F.lit(False)).unionByName(first).groupBy(_ID, _KEY).agg(F.collect_list(F.struct("start", "end", "whole", "h1", "h2", "origin")).alias("marks"))

    # The texts of what repeats, of each key once.
    held = keyed.alias("t").join(marks.alias("m"), F.col(f"t.{_ID}").eqNullSafe(F.col(f"m.{_ID}")) & (F.col(f"t.{_KEY}") == F.col(f"m.{_KEY}")))
    held = held.select(f"t.{_ID}", f"t.{_KEY}", "t." + _TEXT, "m.marks")

    def marked(lines: Column) -> Column:
        return F.transform(
            F.col("marks"),
            lambda m: F.struct(m["whole"].alias("whole"), m["h1"].alias("h1"), m["h2"].alias("h2"), m["origin"].alias("origin"), m["start"].alias("start"), m["end"].alias("end"), F.array_join(F.slice(lines, m["start"] + 1, m["end"] - m["start"]), "\n").alias("text")),
        )

    regions = cut(held.select(_ID, _KEY, F.inline(let(F.split(F.col(_TEXT), "\n", -1), marked))))
    copies = regions.where(~F.col("origin")).alias("x")
    # an origin with several equal rows is there several times: one is enough
    origins = cut(regions.where("origin").groupBy("whole", "h1", "h2").agg(F.first("text").alias("o"))).alias("y")
    return copies.join(origins, ["whole", "h1", "h2"]).where("x.text = y.o").select(_ID, _KEY, "start", "end", "whole")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 2, long_line_words: int = 50) -> DataFrame:
    """(_ld_id, _ld_key, ranges): for each text with lines to remove an array of (start, end), places of lines from 0, end excluded."""
    same = repeated(docs, id_col, text_col, window, divisor, long_line_words)
    runs = _runs(same).groupBy(_ID, _KEY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy(_ID, _KEY).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 2, long_line_words: int = 50, removed_col: str | None = "removed_lines") -> DataFrame:
    """docs with the repeated lines taken out of their texts, and the number of lines taken out in removed_col (None: no such column)."""
    if removed_col in docs.columns:
        raise ValueError(f"docs has a column {removed_col} already")
    if own := [c for c in docs.columns if c.lower().startswith("_ld_")]:
        raise ValueError(f"columns of docs can't be named {own}")
    ranges = cut(repeated_ranges(docs, id_col, text_col, window, divisor, long_line_words))
    key = F.xxhash64(id_col, text_col)
    joined = docs.withColumn(_KEY, key).alias("d").join(ranges.alias("r"), F.col(f"d.{id_col}").eqNullSafe(F.col(f"r.{_ID}")) & (F.col(f"d.{_KEY}") == F.col(f"r.{_KEY}")), "left")
    kept = let(F.split(F.col(f"d.{text_col}"), "\n", -1), lambda lines: _without(lines, F.col("r.ranges")))
    kept = let(kept, lambda lines: F.when(F.exists(lines, lambda x: x.rlike(r"\S")), lines).otherwise(F.array().cast("array<string>")))
    text = F.when(F.col("r.ranges").isNull(), F.col(f"d.{text_col}")).otherwise(F.array_join(kept, "\n"))
    out = joined.select(*(text.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns), *([(_lines(F.col(f"d.{text_col}")) - F.when(F.size(kept) == 0, 0).otherwise(F.size(kept))).alias("_ld_n"), F.col("r.ranges").isNull().alias("_ld_whole")] if removed_col else []))
    if not removed_col:
        return out
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.when(F.col("_ld_whole"), F.lit(0)).otherwise(F.col("_ld_n")).cast("int").alias(removed_col))


def _without(lines: Column, ranges: Column) -> Column:
    """The lines between ranges (start, end) that don't overlap."""

    def between(rs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(rs)), lambda k: let(F.coalesce(F.get(rs, k - 1)["end"], F.lit(0)), lambda s: F.slice(lines, s + 1, F.coalesce(F.get(rs, k)["start"], F.size(lines)) - s)))

    return F.flatten(let(F.array_sort(ranges), between))


def _lines(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))
