"""Glyphs to rows, lines and pages on small made pages."""

from pyspark.sql import functions as F

from examlake.operators import glyphs

SCHEMA = "page long, x0 double, y0 double, x1 double, y1 double, char string, space_before boolean"


def line(page, text, x=0.0, y=0.0, step=5.0, tall=10.0):
    """Glyphs of a line; ^ and _ raise and lower the next character, a blank is a gap, | is a supplied space without one."""
    out, lift, given = [], 0, False
    for c in text:
        if c in "^_":
            lift = 1 if c == "^" else -1
        elif c == " ":
            x += step
        elif c == "|":
            given = True
        else:
            y0, y1 = (y + 4, y + 9) if lift > 0 else (y - 4, y + 3) if lift < 0 else (y, y + tall)
            out.append((page, float(x), float(y0), x + 4.5, float(y1), c, given))
            x, lift, given = x + step, 0, False
    return out


def texts(spark, rows, trust=False):
    found = glyphs.rendered(glyphs.rows(spark.createDataFrame(rows, SCHEMA), ["page"]), ["page"], trust)
    return {(r["page"], r["row"]): (r["text"], list(r["repairs"])) for r in found.collect()}


def test_rows_grow_with_their_extent(spark):
    rows = line(1, "ab", y=100) + [(1, 12.0, 94.0, 14.0, 102.0, ",", False), (1, 20.0, 88.0, 24.0, 96.5, "q", False), (1, 30.0, 80.0, 34.0, 84.0, "z", False), (1, 40.0, 82.0, 44.0, 82.0, "-", False), (2, None, 1.0, 2.0, 3.0, "x", False)]
    got = {r["char"]: r["row"] for r in glyphs.rows(spark.createDataFrame(rows, SCHEMA), ["page"]).collect()}
    assert got == {"a": 0, "b": 0, ",": 0, "q": 0, "z": 1, "-": 1}, "q overlaps the comma only, which belongs to the row by then; a flat box joins the row it lies in"


def test_rendered_lines(spark):
    rows = line(1, "the cat", y=300) + line(1, "10^2^3+x", y=250) + line(1, "H_2O", y=200) + line(1, "59^t^h of", y=150) + line(1, "a^2^b c", y=100) + line(1, "no|w", y=50)
    got = [v for _, v in sorted(texts(spark, rows).items())]
    assert got == [("the cat", []), ("10²³+x", ["superscripts"]), ("H₂O", ["subscripts"]), ("59th of", ["ordinals_joined"]), ("a^(2b) c", ["scripts_marked"]), ("no w", [])]
    trusted = [v[0] for _, v in sorted(texts(spark, line(1, "a b   c", y=10), True).items())]
    assert trusted == ["ab c"], "where spaces are given only a cell's gap breaks"


def test_repairs_of_text(spark):
    said = ["`5 `6 ` 7 x", "~1 ~2 ~ ~ ~", "no sign", None, "/g12a  /uni20AC", "“Café”  – ﬁne​"]
    rows = spark.createDataFrame(list(enumerate(said)), "i long, t string").withColumn("sign", glyphs.currency(F.col("t")))
    got = rows.select("i", "sign", glyphs.with_currency(F.col("t"), F.col("sign")).alias("c"), glyphs.readable(F.col("t")).alias("r"), glyphs.normalised(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["sign"] for r in got] == ["`", None, None, None, None, None]
    assert got[0]["c"] == "₹5 ₹6 ₹7 x" and got[1]["c"] == said[1] and got[3]["c"] is None
    assert got[4]["r"] == "�a � �" and got[5]["n"] == '"Café" - fine' and got[3]["n"] is None


def test_pages_in_reading_order(spark):
    """Two columns under a banner: the banner stands alone, then the left column and the right one."""
    rows = line(1, "BANNER OVER BOTH", x=110, y=700)
    for i in range(12):
        rows += line(1, f"leftwords{i:02d}here", x=20, y=660 - 20 * i) + line(1, f"rightwords{i:02d}too", x=200, y=660 - 20 * i)
    rows += line(2, "onlyone", x=20, y=500)
    lines = glyphs.page_lines(spark.createDataFrame(rows, SCHEMA), ["page"], F.lit(360.0))
    got = lines.orderBy("page", "ordinal").collect()
    one = [r["text"] for r in got if r["page"] == 1]
    assert one[0] == "BANNER OVER BOTH" and got[0]["is_heading"] and got[0]["column"] == -1
    assert one[1:] == [f"leftwords{i:02d}here" for i in range(12)] + [f"rightwords{i:02d}too" for i in range(12)]
    text = glyphs.markdown(lines.withColumn("doc", F.lit(7)), ["doc"]).first()["markdown"]
    assert text.startswith("[page] 1\n\n## BANNER OVER BOTH\n\nleftwords00here\n") and "\n\nrightwords00too\n" in text and text.endswith("[page] 2\n\nonlyone\n")
    ends = glyphs.usable(spark.createDataFrame(rows, SCHEMA).withColumn("doc", F.lit(7)), spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "doc int, page long"), "doc", "page")
    assert {r["doc"]: (r["pages"], r["text_pages"], r["usable"]) for r in ends.collect()} == {7: (2, 2, True), 8: (1, 0, False)}


def test_centred_headings(spark):
    rows = [("Part One", 40.0, 60.0, True), ("Part One.", 40.0, 60.0, False), ("Part One", 5.0, 60.0, False), ("Part One", 40.0, 95.0, False), ("a b c d e f g h i j k l m", 40.0, 60.0, False), ("Off", 10.0, 40.0, False)]
    found = spark.createDataFrame(rows, "t string, a double, b double, want boolean").select("want", glyphs.centred(F.col("t"), F.col("a"), F.col("b"), F.lit(0.0), F.lit(100.0)).alias("got")).collect()
    assert [r["got"] for r in found] == [r["want"] for r in found]
