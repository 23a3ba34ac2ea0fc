import hashlib
import re

import numpy as np
import pytest

from examlake.llm import decontaminate, queries
from examlake.llm.decontaminate import winnow

DOCS, ITEMS = "doc_id long, text string, item_id string, n_words string", "item_id long, text string, doc_id string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = {}
    kept = [(i, words(t)) for i, t in items if words(t)]
    for d, t in docs:
        ws, hit, found = words(t), set(), set()
        for i, iw in kept:
            n = min(10, len(iw))
            windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
            for p in range(len(ws) - n + 1):
                if tuple(ws[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found.add(str(i))
        out[d] = (len(ws), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_against_all_windows(spark, sf, most):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    w = words(items[0][1])
    extra = [None, "", "...", "x " * 9, " ".join(w), " ".join(w[:10]), " ".join(w[1:11]).upper(), " ".join(w[:9]), "a b " + " ".join(w[2:14]) + " c " + " ".join(w[5:15]), "tiny item here", "so a tiny item  HERE, and a tiny item", "alone", "x é-É 12", "y " * 400 + " ".join(w) + " z" * 400]
    top = max(k for k, _ in docs)
    docs += [(top + 1 + i, t) for i, t in enumerate(extra)]
    items += [(900, "tiny item here"), (901, "Alone"), (902, None), (903, " - "), (904, " ".join(w)), (905, "a a a a a a a a a a a a"), (906, "x x x")]
    got = decontaminate.contamination(spark.createDataFrame([(k, t, "q", "r") for k, t in docs], DOCS), spark.createDataFrame([(k, t, "s") for k, t in items], ITEMS), broadcast_rows=most)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got.collect()}
    want = brute(docs, items)
    assert got == want
    assert sum(v[1] > 0 for v in want.values()) > 8


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b c d e f g h i j k", "", "")], DOCS)
    none = spark.createDataFrame([], ITEMS)
    for most in (0, 10):
        assert [tuple(r) for r in decontaminate.contamination(some, none, broadcast_rows=most).collect()] == [(1, 11, 0, [])]
        assert decontaminate.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS), broadcast_rows=most).count() == 0


def test_every_shared_span_leaves_a_fingerprint():
    r = np.random.default_rng(3)
    for _ in range(300):
        span = r.integers(0, 4, 6).astype(np.uint64)
        a, b = (np.r_[r.integers(0, 4, k).astype(np.uint64), span, r.integers(0, 4, 9).astype(np.uint64)] for k in (5, 8))
        at = {tuple(np.atleast_1d(x - 5)) for x in winnow(a)}, {tuple(np.atleast_1d(x - 8)) for x in winnow(b)}
        assert any((i,) in at[0] and (i,) in at[1] for i in range(6))


def test_query_digest(spark, sf):
    r = queries.op8_decontaminate(spark, sf).where("not contaminated").first()
    assert r["items_sha256"] == hashlib.sha256(b"").hexdigest() and r["n_items"] == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_columns_kept(spark, most):
    item = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, f"x {item}", "p", "q"), (1, None, "r", None)], DOCS)
    got = decontaminate.contamination(docs, spark.createDataFrame([(1, item, "")], ITEMS), broadcast_rows=most, keep=["text", "item_id"])
    assert got.columns == ["doc_id", "item_id", "text", "n_words", "n_hit", "items"] and sorted(map(tuple, got.collect()), key=str) == [(1, "p", f"x {item}", 11, 10, ["1"]), (1, "r", None, 0, 0, [])]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_null_and_repeated_keys(spark, most):
    item = "a b c d e f g h i j"
    docs = [(None, f"x {item}"), (None, "x y"), (7, f"{item} z z"), (7, "clean words"), (7, f"{item} y")]
    got = decontaminate.contamination(spark.createDataFrame([(k, t, "", "") for k, t in docs], DOCS), spark.createDataFrame([(1, item, "")], ITEMS), broadcast_rows=most)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got.collect()) == [("7", 2, 0, []), ("7", 11, 10, ["1"]), ("7", 12, 10, ["1"]), ("None", 2, 0, []), ("None", 11, 10, ["1"])]
