"""Issues of options: written before they are exploded, each option's comparable form worked out once."""

from pyspark.sql import functions as F

from examlake.operators import question_rules as V
from examlake.queries import questions


def test_issues_are_written_before_they_are_exploded(spark, sf):
    got = questions.question_options_issues(spark, sf)
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() > 0


def test_option_issues_of_odd_options(spark):
    rows = [(1, ["Same  text", "other", " same text", None, "SAME TEXT"]), (2, ["(a)", "b.", "(c)"]), (3, ["(a)", "word", ""]), (4, []), (5, ["only"]), (6, ["ab", "cd", "x" * 70]), (7, None)]
    df = spark.createDataFrame(rows, "id int, texts array<string>")
    df = df.withColumn("options", F.transform("texts", lambda t: F.struct(t.alias("text"), F.lit(False).alias("is_correct"))))
    got = {r["id"]: r["x"] and [(x["code"], x["field"]) for x in r["x"]] for r in df.select("id", V.option_issues(F.col("options"), F.lit(4)).alias("x")).collect()}
    assert got[7] is None
    assert got[1] == [("option_empty", "option:4"), ("option_duplicate", "option:3"), ("option_duplicate", "option:5")]
    assert got[2] == [("option_count_mismatch", "options")]
    assert got[3] == [("option_count_mismatch", "options"), ("option_label_only", "option:1")]
    assert got[4] == [("no_options", "options")] and got[5] == [("too_few_options", "options")]
    assert got[6] == [("option_count_mismatch", "options"), ("option_length_outlier", "option:3")]
