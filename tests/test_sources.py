from pyspark.sql import functions as F

from examlake.sources import documents, export
from examlake.streaming import jobs


def test_files(spark, tmp_path):
    files = {"a_first-paper.txt": b"\xef\xbb\xbfone\r\ntwo\r\n\r\n", "b.md": "é x".encode("utf-16"), "c.txt": b"bad \xff\xfe\xfd end", "d.txt": b"", "e.exe": b"x", "z.txt": b"\xef\xbb\xbfone\r\ntwo\r\n\r\n", "f.pdf": b"%PDF"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = documents.outcomes(documents.read_files(spark, str(tmp_path)))
    assert {r["name"]: r["outcome"] for r in got.collect()} == {"a_first-paper.txt": "stored", "b.md": "stored", "c.txt": "stored", "d.txt": "empty", "e.exe": "unsupported", "z.txt": "duplicate", "f.pdf": "to_convert"}
    texts = {r["name"]: (r["title"], r["text"]) for r in documents.texts(got).collect()}
    assert texts == {"a_first-paper.txt": ("A First Paper", "one\ntwo\n\n"), "b.md": ("B", "é x"), "c.txt": ("C", "bad � end")}
    held = spark.createDataFrame([(r["digest"],) for r in got.where("name = 'b.md'").collect()], "digest string")
    again = documents.outcomes(documents.read_files(spark, str(tmp_path)), held)
    assert again.where("name = 'b.md'").first()["outcome"] == "duplicate"
    assert [tuple(r) for r in documents.blocks(documents.texts(got).where("name = 'a_first-paper.txt'"), "name", "text").orderBy("order_index").collect()] == [("a_first-paper.txt", 0, "one", 3), ("a_first-paper.txt", 1, "two", 3)]
    assert spark.range(1).select(documents.year_of(F.lit("held in 2019, not 12019")), documents.year_of(F.lit("none 999"))).first()[:] == (2019, None)


def test_paper_as_markdown(spark):
    option = "options array<struct<label:string,text:string,is_correct:boolean>>"
    two = [("a", "x", False), ("b", "y", True)]
    items = [(1, 1, "A", "one?", two), (1, 2, "A", "two?", []), (1, 3, "B", "three?", two), (1, 4, "A", None, None), (2, 1, None, "solo", two)]
    df = spark.createDataFrame(items, f"paper long, no int, section string, stem string, {option}")
    got = {r["paper"]: r["text"] for r in export.markdown(df, "paper", "no", "section", "stem", "options").collect()}
    assert got[1].count("## A\n") == 2 and got[1].index("one?") < got[1].index("## B") < got[1].index("three?") < got[1].index("## Answer key")
    assert "1. one?\n(a) x\n(b) y\n" in got[1] and "\n1. b\n" in got[1] and "## Section" in got[2]
    parts = [r["part"] for r in export.consecutive_groups(df.where("paper = 1"), "paper", "no", "section").orderBy("no").collect()]
    assert parts == [1, 1, 2, 3]
    assert [r[0] for r in spark.createDataFrame([(1.0,), (2.5,), (0.25,), (10.0,)], "v double").select(export.number_text(F.col("v"))).collect()] == ["1", "2.5", "0.25", "10"]


def test_stream_of_jobs_equals_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = jobs.stream_states(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    order = lambda d: sorted(map(tuple, d.collect()))
    assert order(jobs.current_states(spark, str(tmp_path / "out"))) == order(jobs.states(events))
