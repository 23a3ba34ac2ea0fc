"""Pattern inference: what several papers of an exam agree on, by medians, modes and variation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_larger_wins(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, mode, seen``: the most frequent value of each group, the larger of equally frequent ones."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("seen"))
    best = F.max(F.struct("seen", F.col(value).alias("mode")))
    return counts.groupBy(*by).agg(best.alias("x")).select(*by, "x.mode", "x.seen")


def agreement(seen: Column, papers: Column, mean: Column, deviation: Column) -> Column:
    """How surely a section belongs: its presence, less for counts that vary; one sighting says nothing about stability."""
    presence = seen / papers
    steady = F.greatest(F.lit(0.0), 1 - F.try_divide(deviation, mean))
    return F.when(seen == 1, presence * 0.6).when(mean == 0, presence * 0.5).otherwise(presence * (0.5 + 0.5 * steady))


def sections(observed: DataFrame, exam: str, paper: str, section: str, count: str, place: str) -> DataFrame:
    """``exam, section, questions, seen, agreement, order_index, weightage`` from observed section counts.

    Questions are the rounded median of a section's counts; sections without
    any are left out.  Order follows the rounded mean place, then first
    sight.  Weightages sum to 100, the first largest section taking what is left.
    """
    papers = observed.groupBy(exam).agg(F.count_distinct(paper).alias("papers"))
    g = observed.groupBy(exam, section).agg(
        F.round(F.median(count)).cast("long").alias("questions"),
        F.count("*").alias("seen"),
        F.avg(count).alias("mean"),
        F.stddev_pop(count).alias("deviation"),
        F.round(F.avg(place)).cast("long").alias("mean_place"),
        F.min(paper).alias("first_seen"),
    )
    g = g.where("questions > 0").join(papers, exam)
    g = g.withColumn("agreement", F.round(agreement(F.col("seen"), F.col("papers"), F.col("mean"), F.col("deviation")), 2))
    ordered = Window.partitionBy(exam).orderBy("mean_place", "first_seen", section)
    largest = Window.partitionBy(exam).orderBy(F.desc("questions"), "order_index")
    whole = Window.partitionBy(exam)
    g = g.withColumn("order_index", F.row_number().over(ordered) - 1).withColumn("share", F.col("questions") / F.sum("questions").over(whole) * 100)
    left = 100 - F.sum("share").over(whole)
    g = g.withColumn("weightage", F.col("share") + F.when(F.row_number().over(largest) == 1, left).otherwise(0.0))
    return g.select(exam, section, "questions", "seen", "agreement", "order_index", F.round("weightage", 6).alias("weightage"))


def confidence(drafts: DataFrame, totals: DataFrame, exam: str, total: str, matched: Column | None = None) -> DataFrame:
    """``exam, confidence``: section agreement, stability of the total and amount of evidence, between 0.05 and 0.99.

    ``drafts`` is the result of ``sections``; ``totals`` has each paper's total.
    ``matched`` says of a draft whether it has a subject; the share of those
    without one takes up to 35 percent.
    """
    without = F.count_if(~matched) if matched is not None else F.lit(0)
    s = drafts.groupBy(exam).agg((F.sum(F.col("agreement") * F.col("questions")) / F.sum("questions")).alias("section_score"), (without / F.count("*")).alias("unmatched"))
    t = totals.groupBy(exam).agg(F.count("*").alias("papers"), F.avg(total).alias("mean"), F.stddev_pop(total).alias("deviation"))
    steady = F.when(F.col("papers") > 1, F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide("deviation", "mean"), F.lit(0.0)))).otherwise(1.0)
    evidence = F.least(F.lit(1.0), 0.45 + 0.14 * F.col("papers"))
    value = (0.55 * F.col("section_score") + 0.25 * steady + 0.20 * evidence) * (1 - 0.35 * F.col("unmatched"))
    return s.join(t, exam).select(exam, F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), value)), 2).alias("confidence"))


# Patterns of the marking scheme on a paper's first lines.
TIME_LINE, HOURS, MINUTES, NUMBER = r"(?i)\b(?:time|duration)\b", r"(?i)([0-9]{1,2})\s*(?:hours?|hrs?\.?|h\b)", r"(?i)([0-9]{1,3})\s*(?:minutes?|mins?\.?|m\b)", r"([0-9]{1,3})"
TOTAL_MARKS = r"(?i)(?:maximum|max\.?|total|full)\s*marks?\s*[:\-–—=]?\s*([0-9]{1,5}(?:\.[0-9]+)?)"
PER_QUESTION = (
    r"(?i)(?:each|every)\s+(?:question|correct\s+answer|right\s+answer|correct\s+response)[^0-9]{0,40}([0-9]+(?:\.[0-9]+)?)\s*marks?",
    r"(?i)([0-9]+(?:\.[0-9]+)?)\s*marks?\s*(?:will\s*be\s*awarded\s*)?(?:for|per)\s*(?:each\s*)?(?:correct\s*)?(?:answer|question|response)",
    r"(?i)(?:question|answer)\s*(?:carries|carry|is\s*of|worth)\s*([0-9]+(?:\.[0-9]+)?)\s*marks?",
)
PENALTY_LINE = r"(?i)\b(?:negative\s*mark(?:ing|s)?|penalt(?:y|ies)|deduct(?:ed|ion|s)?)\b"
NO_PENALTY = r"(?i)\b(?:no|nil|without|there\s+is\s+no)\b[^.]{0,30}\b(?:negative\s*mark(?:ing|s)?|penalt(?:y|ies)|deduction)\b"
FRACTION, DECIMAL = r"([0-9]{1,2})\s*/\s*([0-9]{1,2})", r"([0-9]*\.?[0-9]+)"


def header_lines(text: Column, most: int = 120) -> Column:
    """The first lines of a document that are not blank, trimmed."""
    return F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _number(line: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(line, pattern, group).try_cast("double")


def duration(lines: Column) -> Column:
    """Minutes from the first line that names a time, hours up to 12 and minutes below 600; null where no line gives any."""

    def of(line: Column) -> Column:
        h, m, bare = (_number(line, p) for p in (HOURS, MINUTES, NUMBER))
        hours = F.when((h > 0) & (h <= 12), h * 60).otherwise(0.0)
        minutes = F.when((m > 0) & (m < 600) & ((hours == 0) | (m >= 5)), m).otherwise(0.0)
        both = hours + minutes
        out = F.when(both > 0, both).when((bare >= 10) & (bare <= 600), bare)
        return F.when(line.rlike(TIME_LINE) & (out <= 600), out.cast("int"))

    return _first(F.transform(lines, of))


def total_marks(lines: Column) -> Column:
    return _first(F.transform(lines, lambda x: _bounded(_number(x, TOTAL_MARKS), 10_000)))


def marks_per_question(lines: Column) -> Column:
    return _first(F.transform(lines, lambda x: F.coalesce(*(_bounded(_number(x, p), 100) for p in PER_QUESTION))))


def _bounded(v: Column, most: float) -> Column:
    return F.when((v > 0) & (v <= most), v)


def negative_marks(lines: Column) -> Column:
    """The penalty for a wrong answer: 0 where a line says there is none, else the first fraction or decimal in (0, 10] of a line on penalties."""

    def of(line: Column) -> Column:
        part = F.try_divide(_number(line, FRACTION), _number(line, FRACTION, 2))
        plain = _first(F.transform(F.regexp_extract_all(line, F.lit(DECIMAL), F.lit(1)), lambda x: _bounded(x.try_cast("double"), 10)))
        return F.when(line.rlike(PENALTY_LINE), F.round(F.coalesce(_bounded(part, 10), plain), 2))

    return F.when(F.exists(lines, lambda x: x.rlike(NO_PENALTY)), F.lit(0.0)).otherwise(_first(F.transform(lines, of)))


def to_multiple(value: Column, of: int) -> Column:
    """The nearest multiple of ``of``, halves away from zero."""
    return (F.round(value / of) * of).cast("long") if of > 1 else F.round(value).cast("long")


def schemes(papers: DataFrame, exam: str, text: str) -> DataFrame:
    """``exam, duration_min, total_marks, marks_per_question, negative_marks``: what the headers of an exam's papers agree on most, the larger of equals.

    Values must be positive to count, but for a penalty that a paper states as none.
    """
    names = ("duration_min", "total_marks", "marks_per_question", "negative_marks")
    read = papers.select(exam, header_lines(F.col(text)).alias("lines")).select(exam, *(f(F.col("lines")).cast("double").alias(n) for f, n in zip((duration, total_marks, marks_per_question, negative_marks), names, strict=True)))
    long = read.select(exam, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names))).alias("x")).select(exam, "x.*")
    found = mode_larger_wins(long, [exam, "name"], "value").groupBy(exam).agg(*(F.max(F.when(F.col("name") == n, F.col("mode"))).alias(n) for n in names))
    return papers.select(exam).distinct().join(found, exam, "left").withColumn("duration_min", F.col("duration_min").cast("int"))


def draft(papers: DataFrame, observed: DataFrame, exam: str, paper: str, section: str, count: str, place: str, round_to: int = 1, usual_marks: float = 1.0) -> DataFrame:
    """One pattern for each exam from its papers (exam, paper, text, questions, options) and their observed sections.

    Papers without questions are counted as skipped and decide nothing; an exam
    with none left has no sections, confidence or marks.  Sections, where there
    are any, set the total; marks are printed ones, else the total times the
    marks of a question.
    """
    usable = papers.where("questions > 0")
    base = papers.groupBy(exam).agg(F.count_if(F.col("questions") > 0).alias("derived_from"), F.count_if(F.coalesce(F.col("questions"), F.lit(0)) <= 0).alias("skipped"))
    totals = usable.groupBy(exam).agg(to_multiple(F.median("questions"), round_to).alias("median_total"))
    options = mode_larger_wins(usable.where("options > 0"), [exam], "options").select(exam, F.col("mode").alias("options"))
    seen = observed.join(usable.select(exam, paper), [exam, paper], "left_semi")
    parts = sections(seen, exam, paper, section, count, place)
    sized = parts.groupBy(exam).agg(F.sum("questions").alias("section_total"), F.count("*").alias("sections"))
    sure = confidence(parts, usable.withColumn("total", F.col("questions")), exam, "total")
    met = base
    for other in (totals, options, schemes(usable, exam, "text"), sized, sure):
        met = met.join(other, exam, "left")
    each = F.when(F.col("marks_per_question") > 0, F.col("marks_per_question")).otherwise(usual_marks)
    questions = F.when(F.col("section_total") > 0, F.col("section_total")).otherwise(F.coalesce("median_total", F.lit(0)))
    made = met.withColumns({"total_questions": questions, "each": each})
    return made.select(
        exam, "derived_from", "skipped", "total_questions", "options", "duration_min", F.col("each").alias("marks_per_question"), F.coalesce("negative_marks", F.lit(0.0)).alias("negative_marks"),
        F.when(F.col("total_marks") > 0, F.col("total_marks")).otherwise(F.col("total_questions") * F.col("each")).alias("total_marks"), F.coalesce("sections", F.lit(0)).alias("sections"), "confidence",
    )
