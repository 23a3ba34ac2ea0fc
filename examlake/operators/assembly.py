"""Quota-constrained selection of questions for the sections of a paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.plans.tables import kept

LEVELS = ("easy", "medium", "hard")


def tie_break(seed: int, column: str) -> Column:
    """A deterministic shuffle that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")).cast("binary"))


def scaled(sections: DataFrame, by: str, order: str, count: str, target: str) -> DataFrame:
    """Add ``want``: a section's share of ``target`` questions of its ``by`` group, at least 1, the last section taking what rounding left.

    Where the target is null or the sections' own total, the sections keep their counts.
    """
    whole, ordered = Window.partitionBy(by), Window.partitionBy(by).orderBy(order)
    share = sections.withColumns({"pattern_total": F.sum(count).over(whole), "is_last": F.lead(F.lit(1)).over(ordered).isNull()})
    keep = F.col(target).isNull() | (F.col(target) <= 0) | (F.col(target) == F.col("pattern_total"))
    part = F.greatest(F.lit(1), F.round(F.col(count) / F.col("pattern_total") * F.col(target)).cast("long"))
    share = share.withColumn("part", F.when(keep, F.col(count)).otherwise(part).cast("long"))
    before = F.sum("part").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    want = F.when(~keep & F.col("is_last"), F.greatest(F.lit(0), F.col(target) - F.coalesce(before, F.lit(0)))).otherwise(F.col("part"))
    return share.withColumn("want", want.cast("long")).drop("pattern_total", "is_last", "part")


def candidates(questions: DataFrame, links: DataFrame, answered: DataFrame) -> DataFrame:
    """Deliverable questions that an exam reaches: passed the gate and have an answer; ``exam_id`` is the reaching exam's."""
    q = questions.where("quality = 'pass'").drop("exam_id")
    return q.join(links, "question_id").join(answered, "question_id", "left_semi")


def selected(pool: DataFrame, quotas: DataFrame, by: list[str], seed: int) -> DataFrame:
    """The chosen questions of every section with their ``phase`` and ``sequence``.

    ``quotas`` has, for each section key ``by``, ``want`` and the percentages
    ``easy, medium, hard``.  Levels are filled to their targets, medium takes the
    remainder, and what is missing is backfilled medium, easy, hard in turn.
    Within a level the more relevant come first, then the seeded shuffle.
    Ranks are taken per section and level, so no section is larger than its pool.
    """
    most = quotas.agg(F.coalesce(F.max("want"), F.lit(0)).cast("int")).first()[0]
    targets = {x: F.expr(f"want * {x} div 100") for x in LEVELS}
    rest = F.col("want") - sum(targets.values(), F.lit(0))
    q = quotas.select(*by, "want", targets["easy"].alias("t_easy"), (targets["medium"] + rest).alias("t_medium"), targets["hard"].alias("t_hard"))
    level = F.when(F.col("difficulty").isin(*LEVELS), F.col("difficulty")).otherwise("medium")
    target = F.when(F.col("level") == "easy", F.col("t_easy")).when(F.col("level") == "hard", F.col("t_hard")).otherwise(F.col("t_medium"))
    in_level = Window.partitionBy(*by, "level").orderBy(F.desc("relevance"), tie_break(seed, "question_id"), "question_id")
    ranked = pool.withColumn("level", level).join(q, by).withColumns({"rank": F.row_number().over(in_level), "target": target})
    # No level ever gives more than the whole quota, so deeper ranks never matter; the largest quota as a literal bounds the sorts inside the tasks.
    ranked = ranked.where(F.col("rank") <= F.lit(most)).where("rank <= want")
    turn = F.when(F.col("rank") > F.col("target"), F.col("rank") - F.col("target"))
    place = {x: F.lit(i) for i, x in enumerate(LEVELS)}
    in_turn = F.when(F.col("level") == "medium", 0).when(F.col("level") == "easy", 1).otherwise(2)
    phase = F.when(turn.isNull(), F.when(F.col("level") == "easy", place["easy"]).when(F.col("level") == "medium", place["medium"]).otherwise(place["hard"])).otherwise(3)
    order = Window.partitionBy(*by).orderBy("phase", F.coalesce("turn", F.lit(0)), F.when(F.col("turn").isNull(), 0).otherwise(in_turn), "rank")
    numbered = ranked.withColumns({"turn": turn, "phase": phase}).withColumn("sequence", F.row_number().over(order))
    return numbered.where("sequence <= want").select(*by, "question_id", "difficulty", "relevance", "phase", "sequence")


# Percent of easy, medium and hard questions by type of paper, and of any other.
MIXES = {"easy": (60, 35, 5), "tough": (10, 35, 55), "speed": (55, 40, 5)}
USUAL_MIX = (30, 50, 20)


def mix_of(kind: Column) -> Column:
    """The mix of a type of paper as ``easy, medium, hard``."""
    mix = lambda values: F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(LEVELS, values, strict=True)))
    out = mix(USUAL_MIX)
    for name, values in MIXES.items():
        out = F.when(F.lower(kind) == name, mix(values)).otherwise(out)
    return out


def normalised_mix(easy: Column, medium: Column, hard: Column) -> Column:
    """The mix scaled to 100 in whole percents, hard taking the rest; the usual mix where the parts sum to nothing."""
    e, m, h = (F.coalesce(p, F.lit(0)).cast("long") for p in (easy, medium, hard))
    total = e + m + h
    share = lambda p: F.when(total == 100, p).otherwise((p * 100 / total).cast("long"))
    return F.when(total <= 0, mix_of(F.lit(""))).otherwise(F.struct(share(e).alias("easy"), share(m).alias("medium"), (100 - share(e) - share(m)).alias("hard")))


def marks(section: Column, pattern: Column, least: Column | None = None) -> Column:
    """The section's marks if positive, else the pattern's, else ``least``."""
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(positive(section), positive(pattern), *([least] if least is not None else []))


def current_patterns(patterns: DataFrame, exam: str, pattern: str) -> DataFrame:
    """The pattern of each exam: the one asked for (``asked``), else the active one, the smallest of several."""
    ranked = F.min(F.struct((~F.coalesce(F.col("asked"), F.lit(False))).alias("not_asked"), F.col(pattern).alias("pattern")))
    return patterns.where("asked or is_active").groupBy(exam).agg(ranked["pattern"].alias(pattern))


def built(pool: DataFrame, sections: DataFrame, paper: str, seed: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The items of every paper and how its sections were filled, each question drawn once.

    ``sections`` has ``paper, section, subject_id, want, easy, medium, hard``, with
    ``section`` counting from 1 to at most ``most``, the longest pattern; ``pool`` has
    ``paper, question_id, subject_id, difficulty, relevance``.  Sections are filled in
    their order and later ones draw from what is left, all papers in one
    round: there are as many rounds as a pattern has sections.  A section
    without a subject draws from all.  Items are numbered through the paper.
    """
    drawn, fills = None, []
    pool = kept(pool, "pool")
    for number in range(1, most + 1):
        now = sections.where(F.col("section") == number)
        left = pool if drawn is None else pool.join(drawn.select(paper, "question_id"), [paper, "question_id"], "left_anti")
        met = left.join(now.select(paper, "section", F.col("subject_id").alias("asked")), paper).where("asked is null or subject_id = asked").drop("asked")
        available = met.groupBy(paper, "section").agg(F.count("*").alias("available"))
        taken = kept(selected(met, now.drop("subject_id"), [paper, "section"], seed), "drawn")
        fills.append(now.join(available, [paper, "section"], "left").join(taken.groupBy(paper, "section").agg(F.count("*").alias("filled")), [paper, "section"], "left"))
        drawn = taken if drawn is None else drawn.union(taken)
    place = F.row_number().over(Window.partitionBy(paper).orderBy("section", "sequence"))
    fill = fills[0]
    for f in fills[1:]:
        fill = fill.union(f)
    fill = fill.na.fill(0, ["available", "filled"])
    reason = F.when(F.col("filled") >= F.col("want"), "filled").when(F.col("available") == 0, "nothing reachable").otherwise("too few answered")
    return drawn.withColumn("item", place), fill.select(paper, "section", "want", "filled", "available", (F.col("want") - F.col("filled")).alias("short"), reason.alias("reason"))
