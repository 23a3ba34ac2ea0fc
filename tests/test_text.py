"""Text functions on small strings."""

from pyspark.sql import functions as F

from examlake.functions import text


def values(spark, rows, of):
    return [r["v"] for r in spark.createDataFrame(list(enumerate(rows)), "i int, s string").select("i", of(F.col("s")).alias("v")).orderBy("i").collect()]


def test_cuts(spark):
    said = ["short", "one two three four five six", "x" * 40, "कखगघ कि की कु", None, ""]
    assert values(spark, said, lambda s: text.cut_at_word(s, 12)) == ["short", "one two…", "x" * 11 + "…", "कखगघ कि क…", None, ""]
    got = values(spark, ["abc", "aé", "aéb", "a€b", "😀x", None], lambda s: text.limited_bytes(s, 3))
    assert [tuple(r) for r in got] == [("abc", False), ("aé", False), ("aé", True), ("a", True), ("", True), (None, None)]


def test_excerpts_and_printable(spark):
    assert values(spark, ["a" * 100, "b" * 10, None], lambda s: text.excerpt(s, F.lit(50))) == ["a" * 60, "", None]
    assert values(spark, ["ab c"], lambda s: text.excerpt(s, F.lit(-1))) == [""]
    assert values(spark, [" a\r\nb\rc\x00\x07\td� ", None], text.printable) == ["a\nb\nc\td", None]


def test_alias_lists(spark):
    assert values(spark, ['[" A ", "", "b"]', "no json", "{}", None], text.aliases_of) == [["A", "b"], [], [], []]
    rows = spark.createDataFrame([([" Quant ", "QUANT", None, " ", "Maths", "quant"],), ([],)], "n array<string>").select(text.stored_aliases(F.col("n")).alias("v")).collect()
    assert [r["v"] for r in rows] == ['["Quant","Maths"]', "[]"]
