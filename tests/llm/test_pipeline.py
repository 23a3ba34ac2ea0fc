"""Every stage of the pipeline against a plain version of it over the same input."""

import os
import sys

import corpus_pipeline
import numpy as np
import pytest
from examlake.llm import queries, toxicity
from examlake.llm.common import bucket_of

sys.path.insert(0, os.path.dirname(__file__))
import test_decontaminate
import test_minhash


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def without_boilerplate(docs):
    pages, on = {}, {}
    words = lambda line: line.strip(" \t\n\x0b\x0c\r")
    for host, text in {(r["source"] or "", r["text"]) for r in docs if r["text"] is not None}:
        pages[host] = pages.get(host, 0) + 1
        for line in {x for x in text.split("\n") if words(x)}:
            on[host, line] = on.get((host, line), 0) + 1
    gone = {k for k, n in on.items() if n >= 5 and n > 0.02 * pages[k[0]]}
    return sorted((r["doc_id"], r["text"] and "\n".join(x for x in r["text"].split("\n") if (r["source"] or "", x) not in gone)) for r in docs)


def test_stages(spark, sf):
    docs = queries.table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "bpe"]

    def stage(name):
        out = corpus_pipeline.written(stages[name](spark, docs, sf), f"test-{name}")
        assert out.columns == list(corpus_pipeline.COLUMNS)
        return out

    model = toxicity.fit(docs, queries.table(spark, sf, "labels").where(bucket_of("doc_id", 3) != 1))
    want = sorted((k, t) for k, t in rows_of(docs) if model.scores(np.array(model.worst([t or ""], {})))[0] < queries.TOXIC)
    docs = stage("toxicity")
    assert sorted(rows_of(docs)) == want

    want = without_boilerplate(docs.collect())
    docs = stage("line_dedup")
    assert sorted(rows_of(docs)) == want

    kept = {k for k, (_, _, smallest) in test_minhash.brute(rows_of(docs)).items() if smallest}
    want = sorted(x for x in rows_of(docs) if x[0] in kept)
    docs = stage("near_dedup")
    assert sorted(rows_of(docs)) == want

    items = [(r["item_id"], r["text"]) for r in queries.table(spark, sf, "benchmark").collect()]
    hit = {k for k, (_, n, _) in test_decontaminate.brute(rows_of(docs), items).items() if n}
    want = sorted(x for x in rows_of(docs) if x[0] not in hit)
    docs = stage("decontaminate")
    assert sorted(rows_of(docs)) == want and len(want) > 100

    want = {r["doc_id"]: r["decoded_sha256"] for r in docs.selectExpr("doc_id", "sha2(text, 256) as decoded_sha256").collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in stages["bpe"](spark, docs, sf).collect()} == want


def test_rows_without_and_with_repeated_keys(spark, sf):
    item = queries.table(spark, sf, "benchmark").first()["text"]
    a, b = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))
    rows = [(7, a), (7, a), (7, b), (8, a), (9, None), (9, ""), (None, b), (None, f"{item} and more"), (7, f"see {item}")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    alone = rows_of(stages["near_dedup"](spark, docs.where("doc_id is null or doc_id <> 7 or text not like 'see %'").where("coalesce(text, '') not like '%and more'"), sf))
    assert sorted(alone, key=str) == sorted([(7, a), (None, b), (9, None), (9, "")], key=str)
    clean = rows_of(stages["decontaminate"](spark, docs, sf))
    assert sorted(clean, key=str) == sorted(rows[:7], key=str)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_empty_documents(spark, sf, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, queries.table(spark, sf, "documents").limit(0), sf).count() == 0
