"""What parsed questions say of themselves: findings, type and confidence of each, and the summary and warnings of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.functions.text import collapse

#: Characters that a stem needs, and options that make a question objective.
LEAST_STEM, LEAST_OPTIONS = 8, 2
#: What each finding of the parser takes off a question's confidence.
COST = {"unreadable_source": 0.5, "no_options": 0.45, "options_replaced": 0.35, "option_overrun": 0.3, "stem_too_short": 0.3, "incomplete_options": 0.2, "trailing_text": 0.15, "context_capped": 0.1}
TRUE_FALSE = ("true|false", "false|true", "yes|no", "no|yes", "correct|incorrect", "incorrect|correct")


def filled(options: Column) -> Column:
    return F.size(F.filter(options, lambda o: F.trim(F.coalesce(o, F.lit(""))) != ""))


def kind(stem: Column, options: Column, right: Column, context: Column, least: int = LEAST_OPTIONS) -> Column:
    """A question's structural type; ``right`` counts its correct options.  Difficulty is never guessed."""
    n, said = filled(options), F.lower(stem)
    has = lambda x: F.contains(said, F.lit(x))
    pair = F.lower(F.concat_ws("|", collapse(F.get(options, F.lit(0))), collapse(F.get(options, F.lit(1)))))
    return (
        F.when((n >= least) & (right > 1), "multi_select")
        .when((n == 2) & (F.size(options) == 2) & pair.isin(*TRUE_FALSE), "true_false")
        .when((n >= least) & (F.coalesce(context, F.lit("")) != ""), "comprehension")
        .when((n >= least) & ((has("assertion") & has("reason")) | (has("statement i") & has("statement ii"))), "assertion_reason")
        .when((n >= least) & has("match the") & (has("column") | has("list")), "match_columns")
        .when(n >= least, "mcq")
        .when(F.contains(stem, F.lit("____")) | F.contains(stem, F.lit("...")), "fill_blank")
        .otherwise("descriptive")
    )


def confidence(issues: Column, stem: Column, options: Column, usual: Column) -> Column:
    """How cleanly a question came out, between 0 and 1; one that fits the document's ``usual`` number of options gains a little."""
    cost = F.aggregate(issues, F.lit(0.0), lambda a, x: a + F.coalesce(*(F.when(x == k, F.lit(v)) for k, v in COST.items()), F.lit(0.0)))
    bonus = F.when((usual > 0) & (filled(options) == usual) & (F.char_length(stem) > 25), 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - cost + bonus))


def finished(parsed: DataFrame, usual: DataFrame, key: str) -> DataFrame:
    """Parsed questions with all ``issues``, ``type`` and ``confidence``; those without a stem and any option are dropped.

    ``parsed`` is the result of ``parsing.questions`` and ``usual`` has each
    document's number of ``options``, as its option style found it.
    """
    unreadable = F.lit("�")
    met = parsed.join(usual.select(key, F.col("options").alias("usual")), key, "left").withColumn("usual", F.coalesce("usual", F.lit(0)))
    met = met.withColumn("options", F.coalesce("options", F.array().cast("array<string>"))).where((F.col("stem") != "") | (filled(F.col("options")) > 0))
    n, held = filled(F.col("options")), F.coalesce("issues", F.array().cast("array<string>"))
    more = F.filter(
        F.array(
            F.when(n == 0, "no_options").when((F.col("usual") > 0) & (n < F.col("usual")), "incomplete_options"),
            F.when(F.char_length("stem") < LEAST_STEM, "stem_too_short"),
            F.when((F.coalesce("trailing", F.lit("")) != "") & ~F.array_contains(held, "option_overrun"), "trailing_text"),
            F.when(F.contains("stem", unreadable) | F.exists("options", lambda o: F.contains(o, unreadable)), "unreadable_source"),
        ),
        lambda x: x.isNotNull(),
    )
    right = F.when(F.col("answer").isNotNull(), 1).otherwise(0)
    out = met.withColumn("issues", F.array_union(held, more))
    return out.withColumns({"type": kind(F.col("stem"), F.col("options"), right, F.col("context")), "confidence": confidence(F.col("issues"), F.col("stem"), F.col("options"), F.col("usual"))})


def summaries(done: DataFrame, docs: DataFrame, key: str, expected: int = 0) -> DataFrame:
    """``key, questions, answered, flagged, confidence, warnings`` of every document of ``docs``, also those without questions.

    Warnings are codes: ``no_questions, no_answer_key, unanswered,
    few_options, below_expected, flagged``.
    """
    thin = (F.col("usual") > 0) & (filled(F.col("options")) < F.col("usual"))
    per = done.groupBy(key).agg(
        F.count("*").alias("questions"), F.count("answer").alias("answered"), F.count_if(F.size("issues") > 0).alias("flagged"), F.count_if(thin).alias("thin"), F.avg("confidence").alias("confidence"),
    )
    met = docs.select(key).distinct().join(per, key, "left").na.fill(0, ["questions", "answered", "flagged", "thin", "confidence"])
    n = F.col("questions")
    found = F.array(
        F.when(n == 0, "no_questions"),
        F.when((n > 0) & (F.col("answered") == 0), "no_answer_key"),
        F.when(F.col("answered") < n, "unanswered"),
        F.when(4 * F.col("thin") > n, "few_options"),
        F.when((n > 0) & (expected - n > expected // 10), "below_expected") if expected else F.lit(None).cast("string"),
        F.when(F.col("flagged") > 0, "flagged"),
    )
    return met.select(key, "questions", "answered", "flagged", "confidence", F.filter(found, lambda x: x.isNotNull()).alias("warnings"))


def better(candidate: DataFrame, incumbent: DataFrame, key: str) -> DataFrame:
    """``key, chosen``: of two readings' summaries the one with over a tenth more questions, else the candidate if it is surer by more than 0.05."""
    a = candidate.select(key, F.col("questions").alias("a"), F.col("confidence").alias("a_sure"))
    b = incumbent.select(key, F.col("questions").alias("b"), F.col("confidence").alias("b_sure"))
    met = a.join(b, key, "full").na.fill(0, ["a", "b", "a_sure", "b_sure"])
    many = lambda x, y: F.col(x) > F.expr(f"{y} * 11 div 10")
    takes = F.when(F.col("a") == 0, False).when(F.col("b") == 0, True).when(many("a", "b"), True).when(many("b", "a"), False).otherwise(F.col("a_sure") > F.col("b_sure") + 0.05)
    return met.select(key, F.when(takes, "candidate").otherwise("incumbent").alias("chosen"))
