"""Glyph boxes to lines of text: rows, word breaks, raised and lowered runs, repairs, headings, markdown and blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from examlake.functions.text import collapse
from examlake.operators import layout

# Ratios to what is measured on the same page.
OVERLAP, SPACE_GAP, CELL_GAP, TRUSTED_SPACES = 0.25, 0.28, 2.5, 0.06
RAISED_HEIGHT, RISE, LOWERED_HEIGHT, LOWERED_TOP = 0.86, 0.22, 0.75, 0.5
HEADING_INDENT, HEADING_WORDS, EVEN_MARGINS = 0.08, 12, 0.6
INTO, LEAST_GLYPHS = 0.5, 200
# Raised and lowered forms of characters, suffixes that are printed raised and read flat, stand-ins of the rupee sign.
RAISED = dict(zip("0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", strict=True))
LOWERED = dict(zip("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", strict=True))
ORDINALS = ("st", "nd", "rd", "th")
RUPEE, RUPEE_STANDS_FOR = "₹", ("`", "¤", "₨", "~")
# What cannot be text, and look-alike punctuation.
UNREADABLE = "\ufffd"
UNMAPPED = r"/(?:g\d{1,5}|uni[0-9A-Fa-f]{4,6}|c\d{1,5})"
UNTEXT = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{E000}-\x{F8FF}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]"
BLANKS, NOTHING = "\u00a0\u2007\u202f\u2009\u200a", "\u200b\u200c\u200d\ufeff"
ALIKE = {"\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u2015": "-"}
LIGATURES = {"\ufb01": "fi", "\ufb02": "fl", "\ufb00": "ff", "\ufb03": "ffi", "\ufb04": "ffl"}


def rows(glyphs: DataFrame, by: list[str]) -> DataFrame:
    """Glyphs (by, x0, y0, x1, y1, ...) with ``row``, numbered from 0 down each page, and ``at``, their place in it by that order.

    A glyph joins the row above it if their extents overlap by a quarter of the
    shorter; the row's extent grows with it, so the border depends on all that
    came before: an ordered sweep.  Spark deals pages out and sorts each; the
    sweep streams and holds two numbers.  A box without height joins the row it
    lies in.  Ties are broken by all other columns.
    """
    names = glyphs.columns
    rest = [c for c in names if c not in (*by, "x0", "y0", "x1", "y1")]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row, place, low, high = None, 0, 0, 0.0, 0.0
        for batch in batches:
            found, places = [], []
            pages = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            for page, y0, y1 in zip(pages, batch.column("y0").to_pylist(), batch.column("y1").to_pylist(), strict=True):
                tall, shorter = y1 - y0, min(y1 - y0, high - low)
                joins = shorter > 0 and min(high, y1) - max(low, y0) >= shorter * OVERLAP or tall <= 0 and low - 0.5 <= y0 <= high + 0.5
                if page != at:
                    at, row, place, low, high = page, 0, 0, y0, y1
                elif joins:
                    place, low, high = place + 1, min(low, y0), max(high, y1)
                else:
                    row, place, low, high = row + 1, place + 1, y0, y1
                found.append(row)
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32()), pa.array(places, pa.int32())], [*names, "row", "at"])

    usable = glyphs.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")})
    kinds = ", ".join(f"`{c}` {usable.schema[c].dataType.simpleString()}" for c in names)
    return usable.repartition(*by).sortWithinPartitions(*by, F.desc("y1"), "x0", "y0", "x1", *rest).mapInArrow(sweep, f"{kinds}, row int, at int")


def _mapped(text: Column, forms: dict[str, str]) -> Column:
    return F.translate(text, "".join(forms), "".join(forms.values()))


def rendered(placed: DataFrame, by: list[str], trust: Column | bool = False) -> DataFrame:
    """The text of each row of glyphs (by, row, at, char, space_before, x0, y0, x1, y1), with its box and what was repaired.

    A word breaks where the document puts a space or a gap exceeds 0.28 of the
    row's median glyph width, 2.5 where ``trust`` says that spaces are given.
    Letters and digits well above or below the row's baseline form runs: letters
    alone become flat, mapped characters take their raised or lowered form, other
    runs are marked ``^(..)`` or ``_(..)``.  Rows that come out empty are left out.
    """
    key = [*by, "row"]
    width, tall = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    trusts = F.lit(trust) if isinstance(trust, bool) else trust
    whole = Window.partitionBy(*key)
    measured = placed.withColumns({
        "gap_limit": F.greatest(F.coalesce(F.median(F.when(width > 0, width)).over(whole), F.lit(1.0)) * F.when(trusts, CELL_GAP).otherwise(SPACE_GAP), F.lit(0.1)),
        "body": F.median(F.when(tall > 0, tall)).over(whole), "baseline": F.median("y0").over(whole),
    })
    rise, body = F.col("y0") - F.col("baseline"), F.col("body")
    raised = (tall < body * RAISED_HEIGHT) & (rise > body * RISE)
    lowered = (tall < body * LOWERED_HEIGHT) & (rise < -body * RISE) & (F.col("y1") < F.col("baseline") + body * LOWERED_TOP)
    kind = F.when(F.col("char").rlike(r"^[\p{L}\p{N}]+\z") & raised, "super").when(F.col("char").rlike(r"^[\p{L}\p{N}]+\z") & lowered, "sub").otherwise("")
    along = Window.partitionBy(*key).orderBy("x0", "at")
    marked = measured.withColumn("kind", F.coalesce(kind, F.lit("")))
    breaks = F.col("body").isNotNull() & F.lag("x1").over(along).isNotNull() & (F.coalesce(F.col("space_before"), F.lit(False)) | (F.col("x0") - F.lag("x1").over(along) > F.col("gap_limit")))
    marked = marked.withColumn("breaks", F.coalesce(breaks, F.lit(False))).withColumn("starts", (F.col("breaks") | (F.col("kind") != F.coalesce(F.lag("kind").over(along), F.lit("")))).cast("int"))
    runs = marked.withColumn("run", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(along))
    runs = runs.groupBy(*key, "run").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("place", "char")))["char"], "").alias("text"), F.first("kind").alias("kind"), F.bool_or("breaks").alias("breaks"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    text, kind = F.col("text"), F.col("kind")
    letters = (kind != "") & text.rlike(r"^\p{L}+\z")
    maps = ((kind == "super") & F.forall(F.split(text, ""), lambda c: c.isin(*RAISED))) | ((kind == "sub") & F.forall(F.split(text, ""), lambda c: c.isin(*LOWERED)))
    piece = F.when((kind == "") | letters, text).when(maps, F.when(kind == "super", _mapped(text, RAISED)).otherwise(_mapped(text, LOWERED))).otherwise(F.concat(F.when(kind == "super", "^(").otherwise("_("), text, F.lit(")")))
    repair = F.when(kind == "", F.lit(None)).when(letters, F.when(F.lower(text).isin(*ORDINALS), "ordinals_joined").otherwise("scripts_flattened")).when(maps, F.when(kind == "super", "superscripts").otherwise("subscripts")).otherwise("scripts_marked")
    made = runs.withColumns({"piece": F.concat(F.when(F.col("breaks"), " ").otherwise(""), piece), "repair": repair}).groupBy(*key).agg(
        F.trim(F.array_join(F.sort_array(F.collect_list(F.struct("run", "piece")))["piece"], "")).alias("text"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))),
        F.sort_array(F.collect_list("repair")).alias("repairs"),
    )
    return made.where("text <> ''")


def currency(text: Column) -> Column:
    """The character of a document's text that stands for the rupee sign, or null: found three times before an amount, and four times in five."""
    hits = lambda c: F.regexp_count(text, F.lit(rf"\Q{c}\E\s?(?=\p{{Nd}})"))
    total = lambda c: F.regexp_count(text, F.lit(rf"\Q{c}\E"))
    return F.coalesce(*(F.when((hits(c) >= 3) & (hits(c) >= 0.8 * total(c)), c) for c in RUPEE_STANDS_FOR))


def with_currency(text: Column, sign: Column) -> Column:
    """The text with ``sign`` and a blank behind it as the rupee sign wherever an amount follows; unchanged without a sign."""
    return F.coalesce(F.regexp_replace(text, F.concat(F.lit(r"\Q"), sign, F.lit(r"\E\s?(?=\p{Nd})")), F.lit(RUPEE)), text)


def readable(text: Column) -> Column:
    """References to unmapped glyphs and code points that cannot be text become U+FFFD, one for each."""
    return F.regexp_replace(F.regexp_replace(text, UNMAPPED, UNREADABLE), UNTEXT, UNREADABLE)


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def normalised(text: Column, compose: bool = True) -> Column:
    """Composed characters, plain punctuation, ligatures spelled out, runs of blanks as one.

    Spark has no composition: with ``compose`` texts beyond ASCII pass through a
    vectorised function, others never leave the JVM's branch.
    """
    done = F.when(text.rlike(r"[^\x00-\x7F]"), _composed(text)).otherwise(text) if compose else text
    done = F.translate(done, BLANKS + "".join(ALIKE) + NOTHING, " " * len(BLANKS) + "".join(ALIKE.values()))
    for form, plain in LIGATURES.items():
        done = F.replace(done, F.lit(form), F.lit(plain))
    return F.trim(F.regexp_replace(done, r"[ \t]{2,}", " "))


def centred(text: Column, x0: Column, x1: Column, left: Column, right: Column) -> Column:
    """A centred title: indented from both edges of its column by about as much, of few words, and no sentence."""
    span, lead, trail = right - left, x0 - left, right - x1
    even = F.abs(lead - trail) <= F.greatest(lead, trail) * EVEN_MARGINS
    short = (F.size(F.split(collapse(text), " ")) <= HEADING_WORDS) & ~text.rlike(r"[.?:;,]\z")
    return F.coalesce((span > 0) & (lead >= span * HEADING_INDENT) & (trail >= span * HEADING_INDENT) & even & short, F.lit(False))


def markdown(lines: DataFrame, by: list[str], page: str = "page", order: str = "ordinal", column: str = "column") -> DataFrame:
    """One text for each document: a mark for every page, a blank line at a change of column, hashes before headings."""
    along = Window.partitionBy(*by, page).orderBy(order)
    gap = F.when(F.coalesce(F.lag(column).over(along) != F.col(column), F.lit(False)), "\n").otherwise("")
    line = F.concat(gap, F.when(F.col("is_heading"), "## ").otherwise(""), F.col("text"))
    pages = lines.withColumn("line", line).groupBy(*by, page).agg(F.array_join(F.sort_array(F.collect_list(F.struct(order, "line")))["line"], "\n").alias("body"))
    whole = F.concat(F.lit("[page] "), F.col(page).cast("string"), F.lit("\n\n"), F.col("body"), F.lit("\n"))
    return pages.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(F.struct(page, whole.alias("text"))))["text"], "\n").alias("markdown"))


def blocks(lines: DataFrame, by: list[str], page: str = "page", order: str = "ordinal") -> DataFrame:
    """Lines as block records in the order of the document."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(page, order)) - 1
    return lines.select(*by, place.alias("order_index"), F.col(page).alias("page_no"), F.when(F.col("is_heading"), "heading").otherwise("paragraph").alias("block_type"), "text", F.lit(0).alias("level"))


def usable(glyphs: DataFrame, pages: DataFrame, document: str, page: str) -> DataFrame:
    """``document, pages, text_pages, glyphs, usable``: whether a text layer has 200 glyphs, and some on half of its pages."""
    per = glyphs.groupBy(document, page).agg(F.count("*").alias("n"))
    found = pages.select(document, page).distinct().join(per, [document, page], "left").groupBy(document).agg(F.count("*").alias("pages"), F.count("n").alias("text_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("glyphs"))
    return found.withColumn("usable", (F.col("glyphs") >= LEAST_GLYPHS) & (F.col("text_pages") >= F.greatest(F.lit(1), F.expr("pages div 2"))))


def page_lines(glyphs: DataFrame, by: list[str], width: Column, bins: int = 240) -> DataFrame:
    """The lines of every page in reading order: ``by, ordinal, column, band, text, x0, y0, x1, y1, is_heading, repairs``.

    Rows that cross a gutter close the band above them and stand alone, with
    column -1; within a band columns follow from left to right, and each is
    grouped into rows of its own.
    """
    page = F.xxhash64(*by)
    placed = rows(glyphs.withColumn("page_width", width), by).withColumn("page_key", page)
    bounds = layout.columns(placed, "page_key", "row", "x0", "x1", F.col("page_width"), bins)
    edges = bounds.groupBy("page_key").agg(F.sort_array(F.collect_list(F.struct("left", "right"))).alias("bounds"))
    spaces = placed.groupBy(*by).agg((F.count_if("space_before") >= TRUSTED_SPACES * F.count("*")).alias("trust"))
    met = placed.join(edges, "page_key").join(spaces, by)
    gutter = F.zip_with(F.slice("bounds", 1, F.size("bounds") - 1), F.slice("bounds", 2, F.size("bounds")), lambda a, b: F.struct(a["right"].alias("from"), b["left"].alias("to")))
    met = met.withColumn("bridges", F.exists(gutter, lambda g: (g["to"] > g["from"]) & (F.col("x1") > g["from"] + INTO) & (F.col("x0") < g["to"] - INTO)))
    crossing = met.groupBy(*by, "row").agg(F.bool_or("bridges").alias("crosses"))
    before = F.sum(F.col("crosses").cast("int")).over(Window.partitionBy(*by).orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    banded = crossing.withColumn("band", 2 * F.coalesce(before, F.lit(0)) + F.col("crosses").cast("int"))
    middle = (F.col("x0") + F.col("x1")) / 2
    nearest = F.array_min(F.transform("bounds", lambda b, i: F.struct(F.greatest(b["left"] - middle, middle - b["right"], F.lit(0.0)).alias("off"), i.alias("column"))))["column"]
    dealt = met.join(banded, [*by, "row"]).withColumn("column", F.when(F.col("crosses"), -1).otherwise(nearest)).drop("row", "at", "bridges", "crosses", "page_key", "page_width")
    within = [*by, "band", "column"]
    text = rendered(rows(dealt.drop("bounds"), within), [*within, "trust"], F.col("trust"))
    lines = text.join(edges.join(placed.select("page_key", *by).distinct(), "page_key"), by).withColumn("b", F.when(F.col("column") >= 0, F.get("bounds", F.col("column"))))
    heading = (F.col("column") < 0) | centred(F.col("text"), F.col("x0"), F.col("x1"), F.col("b.left"), F.col("b.right"))
    ordinal = F.row_number().over(Window.partitionBy(*by).orderBy("band", "column", "row")) - 1
    return lines.select(*by, ordinal.alias("ordinal"), "column", "band", "text", "x0", "y0", "x1", "y1", heading.alias("is_heading"), "repairs")
