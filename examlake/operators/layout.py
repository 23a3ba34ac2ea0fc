"""Reading order from boxes, as joins, groups and windows over glyph and line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """``by, first, last, n``: runs of consecutive numbers; repeated numbers count once."""
    distinct = rows.select(*by, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*by).orderBy(number))
    return distinct.withColumn("island", island).groupBy(*by, "island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("island")


def furniture_key(line: Column) -> Column:
    """A line with digits as #; only letters and # are left, so running headers with page numbers are equal."""
    return F.regexp_replace(F.regexp_replace(line, r"[0-9]+", "#"), r"[^A-Za-z#]", "")


def furniture(lines: DataFrame, document: str, page: str, line: str, share: float = 0.4, least: int = 3) -> DataFrame:
    """``document, key, on_pages, pages`` of keys on at least ``share`` of a document's pages, and on ``least``."""
    keyed = lines.select(document, page, furniture_key(F.col(line)).alias("key")).where("key <> ''")
    pages = lines.groupBy(document).agg(F.count_distinct(page).alias("pages"))
    found = keyed.distinct().groupBy(document, "key").agg(F.count("*").alias("on_pages"))
    return found.join(pages, document).where((F.col("on_pages") >= least) & (F.col("on_pages") >= share * F.col("pages")))


def gutters(glyphs: DataFrame, page: str, row: str, x0: str, x1: str, width: Column, bins: int = 240, clear: float = 0.06, least_width: float = 0.012, most: int = 4) -> DataFrame:
    """``page, from_bin, to_bin, n``: the widest empty vertical bands between a page's columns.

    A bin is clear if fewer than max(1, 6 percent) of the page's rows ink it.  A
    band is as wide as 1.2 percent of the page, two bins at least and one more at
    the page's last ink; one that begins at its first ink is a margin.  A row's
    boxes become spans of bins and these become edges, so rows grow with the boxes
    and not with their width.
    """
    bin_of = lambda x: F.least(F.greatest(F.floor(F.col(x) / width * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    span = F.struct(F.least(bin_of(x0), bin_of(x1)).alias("a"), F.greatest(bin_of(x0), bin_of(x1)).alias("b"))
    spans = glyphs.where(F.col(x0).isNotNull() & F.col(x1).isNotNull()).select(page, row, span.alias("s")).groupBy(page, row).agg(F.sort_array(F.collect_list("s")).alias("spans"))
    last = lambda a: F.get(a, F.size(a) - 1)
    grown = lambda a, s: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["a"].alias("a"), F.greatest(last(a)["b"], s["b"]).alias("b"))))
    step = lambda a, s: F.when((F.size(a) > 0) & (s["a"] <= last(a)["b"] + 1), grown(a, s)).otherwise(F.array_append(a, s))
    inked = F.aggregate("spans", F.array().cast("array<struct<a:int,b:int>>"), step)
    # A row's ink is an edge up and one down for each of its spans; -1 counts the row.
    edge = lambda at, n: F.struct(at.cast("int").alias("at"), F.lit(n).alias("n"))
    edges = F.concat(F.array(edge(F.lit(-1), 1)), F.transform("inked", lambda s: edge(s["a"], 1)), F.transform("inked", lambda s: edge(s["b"] + 1, -1)))
    steps = spans.select(page, inked.alias("inked")).select(page, F.explode(edges).alias("e")).groupBy(page, F.col("e.at").alias("at")).agg(F.sum("e.n").alias("n"))
    along, whole = Window.partitionBy(page).orderBy("at"), Window.partitionBy(page)
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    all_rows = F.max(F.when(F.col("at") < 0, F.col("n"))).over(whole)
    met = steps.withColumns({"all_rows": all_rows, "rows": F.sum(F.when(F.col("at") >= 0, F.col("n")).otherwise(0)).over(so_far), "until": F.lead("at").over(along) - 1, "left": F.min(F.when(F.col("at") >= 0, F.col("at"))).over(whole), "right": F.max("at").over(whole) - 1})
    met = met.where("at >= 0 and until is not null").withColumn("free", F.col("rows") < F.greatest(F.lit(1.0), clear * F.col("all_rows")))
    met = met.withColumn("band", F.sum((~F.col("free")).cast("int")).over(so_far)).where("free")
    least = max(2, int(least_width * bins))
    bands = met.groupBy(page, "band").agg(F.min("at").alias("first"), F.max("until").alias("last"), F.first("left").alias("left"), F.first("right").alias("right"))
    bands = bands.withColumn("n", (F.col("last") - F.col("first") + 1).cast("long")).where((F.col("first") > F.col("left")) & (F.col("n") >= least + (F.col("last") == F.col("right")).cast("int")))
    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.desc("n"), "first"))
    return bands.withColumn("rank", rank).where(F.col("rank") <= most).select(page, F.col("first").alias("from_bin"), F.col("last").alias("to_bin"), "n")


def bands(rows: DataFrame, page: str, top: str, crosses: str) -> DataFrame:
    """Add ``band``: rows between two full-width rows share one; a full-width row closes a band and stands alone."""
    w = Window.partitionBy(page).orderBy(F.desc(top))
    before = F.sum(F.col(crosses).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("band", 2 * F.coalesce(before, F.lit(0)) + F.col(crosses).cast("int"))


def columns(glyphs: DataFrame, page: str, row: str, x0: str, x1: str, width: Column, bins: int = 240, least_width: float = 0.04, least_share: float = 0.04) -> DataFrame:
    """``page, column, left, right, glyphs``: what lies between the gutters, wider than 4 percent of the page and with 4 percent of its glyphs.

    A glyph belongs to the column that holds its middle, else to the nearest,
    the left one of two; a page whose columns are all too thin is one column.
    """
    keyed = glyphs.withColumns({"x0": F.col(x0), "x1": F.col(x1), "width": width})
    ink = keyed.groupBy(page).agg(F.min("x0").alias("from"), F.max("x1").alias("to"), F.max("width").alias("width"), F.count("*").alias("all"))
    bands = gutters(keyed, page, row, "x0", "x1", F.col("width"), bins).groupBy(page).agg(F.sort_array(F.collect_list(F.struct("from_bin", "to_bin"))).alias("bands"))
    edge = lambda b: b * F.col("width") / bins
    none = F.array().cast("array<struct<from_bin:int,to_bin:int>>")
    met = ink.join(bands, page, "left").withColumn("bands", F.coalesce("bands", none))
    starts = F.concat(F.array("from"), F.transform("bands", lambda b: edge(b["to_bin"] + 1)))
    ends = F.concat(F.transform("bands", lambda b: edge(b["from_bin"])), F.array("to"))
    bounds = F.filter(F.arrays_zip(starts.alias("left"), ends.alias("right")), lambda b: b["right"] - b["left"] > least_width * F.col("width"))
    whole = F.array(F.struct(F.col("from").alias("left"), F.col("to").alias("right")))
    met = met.withColumn("bounds", F.when(F.size(bounds) > 0, bounds).otherwise(whole))
    middle = (F.col("x0") + F.col("x1")) / 2
    apart = F.transform("bounds", lambda b, i: F.struct(F.greatest(b["left"] - middle, middle - b["right"], F.lit(0.0)).alias("off"), i.alias("column")))
    held = keyed.join(met.select(page, "bounds"), page).groupBy(page, F.array_min(apart)["column"].alias("at")).agg(F.count("*").alias("glyphs"))
    kept = held.join(met, page).where(F.col("glyphs") >= least_share * F.col("all")).select(page, F.get("bounds", F.col("at")).alias("b"), "glyphs")
    order = F.row_number().over(Window.partitionBy(page).orderBy("b.left")) - 1
    return kept.select(page, order.alias("column"), "b.left", "b.right", "glyphs")


def stacked(lines: DataFrame, page: str, column: str, top: str, text: str, most: int = 24) -> DataFrame:
    """``page, stacked, lines``: short lines, half of them digits, that follow closer than 0.6 of their column's usual pitch.

    Pitches are gaps between 0 and 100; a column of fewer than four lines, or of
    fewer than three pitches, has none.
    """
    below = F.lead(top).over(Window.partitionBy(page, column).orderBy(F.desc(top)))
    gaps = lines.withColumn("gap", F.col(top) - below)
    steps = F.when((F.col("gap") > 0) & (F.col("gap") < 100), F.col("gap"))
    pitch = gaps.groupBy(page, column).agg(F.median(steps).alias("pitch"), F.count(steps).alias("steps"), F.count("*").alias("n")).where("n >= 4 and steps >= 3")
    digits = F.regexp_count(text, F.lit("[0-9]"))
    close = (F.col("gap") > 0) & (F.col("gap") < 0.6 * F.col("pitch")) & (F.char_length(text) <= most) & (digits > 0) & (2 * digits >= F.char_length(F.replace(F.col(text), F.lit(" "))))
    return gaps.join(pitch.select(page, column, "pitch"), [page, column], "left").groupBy(page).agg(F.count_if(close).alias("stacked"), F.count("*").alias("lines"))


def confidence(pages: Column, empty: Column, unstructured: Column, thin: Column, chars: Column, unreadable: Column, stacked: Column) -> Column:
    """How far a document's layout can be trusted, from counts of its pages, characters and repairs; without pages not at all.

    ``thin`` pages have text but fewer than five lines.
    """
    text = pages - empty
    bad = F.coalesce(F.try_divide(unreadable, chars), F.lit(0.0))
    value = (
        1.0
        - 0.9 * F.try_divide(empty, pages)
        - 0.5 * F.try_divide(unstructured, pages)
        - F.coalesce(0.3 * F.try_divide(thin, text), F.lit(0.0))
        - F.when(bad > 0.001, F.least(F.lit(0.4), 20 * bad)).otherwise(0.0)
        - F.least(F.lit(0.1), stacked / 400.0)
    )
    return F.when(pages == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
