"""Documents into a bank, again and again."""

from examlake.operators import ingest

BANK = "question_id string, document_id long, content_hash string, answer int, stem string"
PARSED = "document_id long, seq int, content_hash string, answer int, stem string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ingest_again_changes_nothing(spark):
    bank = spark.createDataFrame([("a", 1, "h1", None, "one"), ("b", 1, "h2", 0, "two"), ("c", 2, "h3", 1, "three"), ("d", None, "h4", None, "four"), ("e", 1, None, None, "five")], BANK)
    parsed = spark.createDataFrame([(1, 1, "h1", 2, "one"), (1, 2, "h3", 3, "three"), (1, 3, "h5", None, "six"), (1, 4, "h5", None, "six"), (3, 1, "h5", 1, "six"), (3, 2, "h4", 3, "four"), (3, 3, "h4", 2, "four"), (3, 4, None, None, "x"), (3, 5, None, None, "x")], PARSED)
    papers = spark.createDataFrame([("b",), ("nowhere",)], "question_id string")
    once, links = ingest.ingested(bank, parsed, papers)
    assert rows(once) == rows(
        spark.createDataFrame([("b", None, "h2", 0, "two"), ("c", 2, "h3", 1, "three"), ("d", None, "h4", 3, "four"), ("n1:1", 1, "h1", 2, "one"), ("n1:3", 1, "h5", 1, "six"), ("n1:4", 1, "h5", None, "six"), ("n3:4", 3, None, None, "x"), ("n3:5", 3, None, None, "x")], BANK)
    )
    assert {(r["document_id"], r["seq"]): (r["question_id"], r["reused"]) for r in links.collect()} == {
        (1, 1): ("n1:1", False), (1, 2): ("c", True), (1, 3): ("n1:3", False), (1, 4): ("n1:4", False), (3, 1): ("n1:3", True), (3, 2): ("d", True), (3, 3): ("d", True), (3, 4): ("n3:4", False), (3, 5): ("n3:5", False)
    }
    twice, again = ingest.ingested(once, parsed, papers)
    assert rows(twice) == rows(once) and rows(again) == rows(links)
    empty = ingest.ingested(bank, parsed.limit(0), papers)
    assert rows(empty[0]) == rows(bank) and not empty[1].take(1)


def test_a_question_in_a_paper_is_reused_by_its_own_document(spark):
    bank = spark.createDataFrame([("a", 1, "h1", None, "one")], BANK)
    parsed = spark.createDataFrame([(1, 1, "h1", 2, "one")], PARSED)
    once, links = ingest.ingested(bank, parsed, bank.select("question_id"))
    assert rows(once) == [("a", None, "h1", 2, "one")] and links.first()["question_id"] == "a"
    assert rows(ingest.ingested(once, parsed, bank.select("question_id"))[0]) == rows(once)


def test_spliced_pages(spark):
    pages = spark.createDataFrame([(1, 1, 0, "one"), (1, 2, 1, ""), (1, 2, 2, "again"), (2, 1, 0, None)], "document int, page int, ordinal int, text string")
    read = spark.createDataFrame([(1, 2, " new two "), (1, 9, "nine"), (1, 4, "four"), (1, 1, "  "), (3, 1, "three")], "document int, page int, text string")
    got = {r["document"]: r["text"] for r in ingest.joined(ingest.spliced(pages, read, "document"), "document").collect()}
    assert got == {1: "[page] 1\n\none\n\n[page] 2\n\nnew two\n\n[page] 2\n\nagain\n\n[page] 4\n\nfour\n\n[page] 9\n\nnine", 2: "[page] 1\n\n", 3: "[page] 1\n\nthree"}
