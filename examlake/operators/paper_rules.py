"""Paper-level rules: grouped checks over the items of papers, and their score."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.functions import rules
from examlake.functions.text import compact
from examlake.operators import question_rules as V
from examlake.operators.assembly import LEVELS
from examlake.operators.question_rules import PAPER_COST, clamped, when


def repeated(items: DataFrame, paper: str, key: Column, order: str) -> DataFrame:
    """Second and later items of a paper with the same key, with the place of the first; null and empty keys never repeat."""
    w = Window.partitionBy(paper, "key").orderBy(order)
    rows = items.withColumn("key", key).where("key is not null and cast(key as string) <> ''")
    return rows.withColumns({"turn": F.row_number().over(w), "first": F.first(order).over(w)}).where("turn > 1").drop("turn", "key")


def stem_key(stem: Column, passage: Column) -> Column:
    """The comparison key of a stem behind that of its passage."""
    own = compact(F.coalesce(stem, F.lit("")))
    return F.when(own != "", F.concat(F.coalesce(passage.cast("string"), F.lit("")), F.lit("|"), own))


def key_skew(items: DataFrame, paper: str, position: str) -> DataFrame:
    """``paper, answered, positions, top_share, skewed``: whether the single right answers of a paper crowd one position.

    Below twenty such items nothing is skewed; one position alone is, and so is
    a share over twice the even one, or over 45 percent of four or more.
    """
    per = items.where(F.col(position).isNotNull()).groupBy(paper, position).agg(F.count("*").alias("n"))
    total = per.groupBy(paper).agg(F.sum("n").alias("answered"), F.count("*").alias("positions"), F.max("n").alias("top"))
    share = F.expr("top * 100 div answered")
    skewed = (F.col("positions") < 2) | (share > 2 * F.expr("100 div positions")) | ((F.col("positions") >= 4) & (share > 45))
    return total.select(paper, "answered", "positions", share.alias("top_share"), ((F.col("answered") >= 20) & skewed).alias("skewed"))


def sequence_gaps(items: DataFrame, paper: str, sequence: str) -> DataFrame:
    """The first item of each paper whose number is not its place."""
    place = F.row_number().over(Window.partitionBy(paper).orderBy(sequence))
    off = items.withColumn("place", place).where(F.col(sequence) != F.col("place"))
    return off.groupBy(paper).agg(F.min(F.struct("place", F.col(sequence).alias("number"))).alias("x")).select(paper, F.col("x.place").alias("place"), F.col("x.number").alias("number"))


def section_counts(expected: DataFrame, items: DataFrame, by: list[str], tolerance: Column | int = 0) -> DataFrame:
    """Expected against found sections by an outer join, with the severity of each difference; ``tolerance`` may be a column of ``expected``."""
    found = items.groupBy(*by).agg(F.count("*").alias("found"))
    both = expected.join(found, by, "full").na.fill(0, ["want", "found"])
    code = F.when((F.col("want") > 0) & (F.col("found") == 0), "paper_section_missing").when(F.col("want") != F.col("found"), "paper_section_count_mismatch")
    grave = (F.col("found") == 0) | (F.col("want") - F.col("found") > tolerance) | (F.col("found") > F.col("want"))
    return both.select(*by, "want", "found", code.alias("code"), F.when(code.isNotNull(), F.when(grave, "critical").otherwise("major")).alias("severity"))


#: Points of a hundred that a share of a level may be off.
DIFFICULTY_TOLERANCE = 15


def _paper_issues(papers: DataFrame, items: DataFrame) -> DataFrame:
    """What one row of totals says of each paper."""
    level = lambda x: F.count_if(F.col("difficulty") == x).alias(x)
    totals = items.groupBy("paper").agg(F.count("*").alias("n"), F.sum("marks").alias("marks"), F.count_distinct("negative").alias("penalties"), *map(level, LEVELS))
    met = papers.join(totals, "paper", "left").na.fill(0, ["n"])
    some, short = F.col("n") > 0, F.col("questions") - F.col("n")
    asked = F.coalesce(F.col("want.easy") + F.col("want.medium") + F.col("want.hard"), F.lit(0))
    # Shares are whole percents; hard takes what rounding leaves.
    easy, medium = F.expr("want.easy * 100 div nullif(want.easy + want.medium + want.hard, 0)"), F.expr("want.medium * 100 div nullif(want.easy + want.medium + want.hard, 0)")
    want = {"easy": easy, "medium": medium, "hard": 100 - easy - medium}
    off = lambda x: F.abs(F.expr(f"{x} * 100 div nullif(n, 0)") - want[x]) > DIFFICULTY_TOLERANCE
    found = F.concat(
        when(~some, "paper_empty", "critical"),
        when(some & (F.col("questions") > 0) & (short != 0), "paper_question_count_mismatch", F.when((short > 0) & (short <= F.col("tolerance")), "major").otherwise("critical")),
        when(some & (F.col("expected_marks") > 0) & (F.abs(F.col("marks") - F.col("expected_marks")) > 0.01), "paper_marks_mismatch", "critical"),
        when(some & (F.abs(F.col("header_marks") - F.col("marks")) > 0.01), "paper_marks_mismatch", "critical"),
        when(some & (F.col("expected_negative") > 0) & (F.col("penalties") > 1), "paper_negative_marks_wrong", "major"),
        when(some & (F.col("expected_negative") > 0) & (F.coalesce("header_negative", F.lit(0.0)) <= 0), "paper_negative_marks_wrong", "critical"),
        when(some & (F.coalesce("minutes", F.lit(0)) <= 0), "paper_duration_missing", F.when(F.col("expected_minutes") > 0, "critical").otherwise("major")),
        when(some & (F.col("minutes") > 0) & (F.col("expected_minutes") > 0) & (F.col("minutes") != F.col("expected_minutes")), "paper_duration_missing", "major"),
        when(some & (asked > 0) & ~F.col("rated"), "paper_difficulty_unrated", "major"),
        *(when(some & (asked > 0) & F.col("rated") & off(x), "paper_difficulty_distribution_off", "major") for x in LEVELS),
        when(some & F.col("model_expected") & ~F.coalesce("model_ran", F.lit(False)), "model_review_not_run", "major"),
    )
    return met.select("paper", F.inline(found))


def _item_issues(items: DataFrame) -> DataFrame:
    """What each item says alone; every rule is an array of issues, so the items are read once."""
    options = F.coalesce("options", F.array().cast(items.schema["options"].dataType))
    field, right = F.concat(F.lit("q"), F.col("sequence").cast("string")), V.correct(options)
    said = V.claimed(F.coalesce("explanation", F.lit("")), options)
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    corrupt = F.transform(rules.inspected(text("stem")), lambda c: V.issue(F.when(c == "placeholder", "paper_placeholder").otherwise("paper_corrupt_question"), "critical", field))
    choice = lambda t, i: F.transform(rules.inspected(t), lambda c: V.issue("paper_corrupt_question", "critical", F.concat(field, F.lit(" "), V.at(i))))
    needs = F.coalesce(F.col("type") == "comprehension", F.lit(False)) | F.col("passage_id").isNotNull()
    found = F.concat(
        when(F.col("quality") == "failed", "paper_failed_question", "critical", field),
        when(~F.coalesce("quality", F.lit("")).isin("pass", "failed"), "paper_unvetted_question", "critical", field),
        when(~F.coalesce("has_answer", F.lit(False)) & (F.size(right) == 0) & (text("answer") == ""), "paper_missing_answer", "critical", field),
        corrupt,
        V.per_option(options, choice),
        when((F.size(right) == 1) & (said != F.get(right, F.lit(0))), "paper_answer_explanation_mismatch", "critical", field),
        when(needs & (text("passage") == ""), "paper_broken_passage", "critical", field),
    )
    return items.select("paper", F.inline(found))


def validated(papers: DataFrame, items: DataFrame, sections: DataFrame) -> DataFrame:
    """``paper, code, severity, field``, each code and field once for a paper, at its worst.

    ``papers`` has ``paper, questions, tolerance, expected_marks, header_marks,
    expected_negative, header_negative, minutes, expected_minutes, want
    struct<easy,medium,hard>, rated, model_expected, model_ran``; null or 0 expects
    nothing.  ``sections`` has ``paper, section, want``.  ``items`` has ``paper,
    sequence, section, subject, question_id, stem, options, answer,
    explanation, passage_id, passage, type, difficulty, quality, has_answer,
    marks, negative``; of a paper's equal sequences the smaller question comes
    first.  An empty paper has that one issue.
    """
    items = items.join(papers.select("paper"), "paper", "left_semi")
    issue = lambda df, code, severity, field: df.select("paper", *(x.alias(n) for x, n in zip((code, severity, field), ("code", "severity", "field"), strict=True)))
    filled = items.select("paper").distinct()
    by_section = section_counts(sections.join(filled, "paper", "left_semi").join(papers.select("paper", "tolerance"), "paper"), items.select("paper", "section"), ["paper", "section"], F.coalesce("tolerance", F.lit(0))).where("code is not null and want > 0")
    mixed = items.groupBy("paper", "section").agg(F.count_distinct("subject").alias("n")).where("n > 1")
    named = F.concat(F.lit("section:"), F.col("section"))
    place = F.row_number().over(Window.partitionBy("paper").orderBy("sequence", "question_id"))
    placed = items.withColumn("place", place)
    at = F.concat(F.lit("q"), F.col("sequence").cast("string"))
    passage = F.coalesce(F.concat(F.lit("p"), F.col("passage_id").cast("string")), F.nullif(compact(F.coalesce("passage", F.lit(""))), F.lit("")))
    right = V.correct(F.coalesce("options", F.array().cast(items.schema["options"].dataType)))
    skew = key_skew(items.withColumn("right", F.when(F.size(right) == 1, F.get(right, F.lit(0)))), "paper", "right").where("skewed")
    critical, major = F.lit("critical"), F.lit("major")
    every = [
        _paper_issues(papers, items),
        by_section.select("paper", "code", "severity", named.alias("field")),
        issue(mixed, F.lit("paper_subject_distribution_off"), major, named),
        issue(repeated(placed, "paper", F.col("question_id"), "place"), F.lit("paper_duplicate_question"), critical, at),
        issue(repeated(placed, "paper", stem_key(F.col("stem"), passage), "place"), F.lit("paper_repeated_stem"), critical, at),
        _item_issues(items),
        issue(skew, F.lit("paper_answer_key_skewed"), major, F.lit("")),
        issue(sequence_gaps(items, "paper", "sequence"), F.lit("paper_sequence_gap"), major, F.concat(F.lit("q"), F.col("number").cast("string"))),
    ]
    rank = F.array_position(F.array(*map(F.lit, V.SEVERITIES)), F.col("severity"))
    found = functools.reduce(DataFrame.unionByName, every).groupBy("paper", "code", "field").agg(F.min(F.struct(rank.alias("rank"), "severity")).alias("x"))
    return found.select("paper", "code", "x.severity", "field")


def score(critical: Column, major: Column, minor: Column, questions: Column) -> Column:
    """A paper's score for display; an empty paper has 0."""
    left = 1.0 - critical * PAPER_COST["critical"] - major * PAPER_COST["major"] - minor * PAPER_COST["minor"]
    return F.when(questions == 0, 0.0).otherwise(clamped(left))
