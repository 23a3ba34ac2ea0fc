import random
import re

import numpy as np

from examlake.llm import linking, minhash
from examlake.llm.components import components

SCHEMA = "doc_id long, text string, component_id long, n string"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {k: shingle_set(t) for k, t in rows}
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = sorted((find(a), find(b)))
                top[v] = u
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


def check(spark, rows):
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def edited(r, base, n):
    out = list(base)
    for i in r.sample(range(len(out)), n):
        out[i] = "".join(r.choice("stuvwxyz") for _ in range(5))
    return out


def test_against_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    top = max(k for k, _ in rows)
    extra = [None, "", " \n ", "one", "One", "one two three", "ONE two\tthree", "a b c d e", "A B C D E f", "É è", "é È", "x " * 5000]
    check(spark, rows + [(top + 1 + i, t) for i, t in enumerate(extra)])


def test_groups_whose_smallest_member_is_no_centre(spark):
    """Every copy is close to the original, copies are far from each other, and the original has the largest key."""
    r = random.Random(5)
    base = words(r, 300)
    rows = [(i, " ".join(edited(r, base, 9))) for i in range(40)] + [(99, " ".join(base))]
    other = words(r, 300)
    rows += [(200 + i, " ".join(edited(r, other, k))) for i, k in enumerate((0, 2, 4, 30, 31))]
    rows += [(300 + i, " ".join(base[:120] + words(r, 180))) for i in range(30)]
    check(spark, rows)


def test_blocks_of_a_bucket_miss_no_link(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 4)
    monkeypatch.setattr(linking, "RUN", 3)
    test_groups_whose_smallest_member_is_no_centre(spark)


def test_rows_without_key_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1, ""), (None, "a b c d e f", 1, ""), (4, "a b c d e f", 1, "")], SCHEMA)
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == [(4, 2, 4, True), (None, 2, None, True), (None, 2, None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keys_that_repeat_follow_their_own_text(spark):
    r = random.Random(9)
    a, b, c = (words(r, 60) for _ in range(3))
    near = lambda x: " ".join([*x[:-1], "end"])
    rows = [(5, " ".join(a)), (7, " ".join(b)), (7, " ".join(c)), (9, near(a)), (8, near(b)), (8, near(c)), (9, near(a)), (20, "alone here")]
    got = sorted(tuple(r)[::2] for r in minhash.near_duplicates(spark.createDataFrame([(k, t, 0, "x") for k, t in rows], SCHEMA)).collect())
    assert got == [(5, 5), (7, 7), (7, 7), (8, 7), (8, 7), (9, 5), (9, 5), (20, 20)]
    # Keys of several columns are as good as numbers.
    from pyspark.sql import functions as F

    keyed = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(rows)], "a long, b long, text string").select(F.struct("a", "b").alias("id"), "text")
    found = minhash.near_duplicates(keyed, "id").where("kept").select("id.b").collect()
    assert sorted(r["b"] for r in found) == [0, 1, 2, 7]


def test_second_hub_joins_what_the_first_does_not(spark, monkeypatch):
    blocks = []
    true = linking._block_links
    monkeypatch.setattr(linking, "_block_links", lambda sets, members, percent: blocks.append(members.count()) or true(sets, members, percent))
    r = random.Random(2)
    base = words(r, 300)
    check(spark, [(i, " ".join(edited(r, base, 6))) for i in range(60)] + [(100, " ".join(base))])
    assert blocks in ([], [0]) or blocks[0] < 60 * minhash.BANDS


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for shared, each in ((90, 10), (300, 100), (5, 5), (20000, 3000)):
        x = r.integers(0, 1 << 63, shared + 2 * each).astype(np.uint64)
        a, b = minhash.super_minhash(np.unique(x[: shared + each]), 400), minhash.super_minhash(np.unique(np.r_[x[:shared], x[shared + each :]]), 400)
        assert abs((a == b).mean() - shared / (shared + 2 * each)) < 0.09


def test_signature_is_the_minimum_over_elements():
    x = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = minhash.super_minhash(x, 64).view(np.float64)
    parts = np.minimum.reduce([minhash.super_minhash(x[i : i + 1], 64).view(np.float64) for i in range(len(x))])
    assert (whole == parts).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(300, 300), (7, 3), (None, 4)] + [(5, 4)] * 3
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_sketches_never_hide_a_partner():
    """Bits in which sketches differ bound the elements in which sets differ from below, also across sizes."""
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 120, 130, 1000)]
    sets += [np.unique(np.r_[s[len(s) // 8 :], r.integers(0, 1 << 63, len(s) // 9).astype(np.uint64)]) for s in sets]
    sizes, comps = np.array([len(s) for s in sets]), np.arange(len(sets))
    for percent in (50, 75, 85):
        may = linking._may_link(sizes, comps, [linking.sketch_of(s) for s in sets], None, percent)
        for i, a in enumerate(sets):
            assert may[i] or not any(linking.similar(a, b, percent) for j, b in enumerate(sets) if i != j)
    assert not linking._may_link(sizes[:5], comps[:5], [linking.sketch_of(s) for s in sets[:5]], None, 75).any()
