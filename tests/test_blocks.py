"""Similar pairs block by block: all pairs, and no candidates in a shuffle."""

import random

from examlake.operators import duplicates
from examlake.operators.duplicates import similar_pairs
from test_duplicates import grams


def brute(rows, percent):
    held = sorted((k, s, grams(t)) for k, s, t in rows)
    out = set()
    for i, (a, s, x) in enumerate(held):
        for b, o, y in held[i + 1 :]:
            if s == o and 100 * len(x & y) >= percent * len(x | y):
                out.add((a, b, len(x & y), len(x | y)))
    return out


def test_blocks_and_bands_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 7)
    pick = random.Random(5)
    words = ["".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 7))) for _ in range(40)]
    texts = {" ".join(pick.choice(words) for _ in range(pick.randint(3, 25))) for _ in range(60)}
    for t in list(texts):
        texts |= {f"{t} {pick.choice(words)}", " ".join(t.split()[:-1])}
    rows = [(i, pick.choice("xy"), t) for i, t in enumerate(sorted(t for t in texts if t))]
    df = spark.createDataFrame([*rows, (1000, None, rows[0][2]), (1001, None, rows[0][2] + " more"), (1002, "x", None)], "id long, subject string, stem string")
    for percent in (40, 82, 100):
        got = similar_pairs(df, "id", "subject", "stem", percent, least_bytes=1)
        assert {tuple(r) for r in got.collect()} == brute(rows, percent)
    assert got.count() == len(brute(rows, 100))


def test_candidates_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "x", "alpha bravo charlie delta echo foxtrot golf hotel"), (2, "x", "alpha bravo charlie delta echo foxtrot golf india")], "id long, subject string, stem string")
    plan = similar_pairs(df, "id", "subject", "stem")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")  # nothing is joined behind the comparison


def test_trigrams_are_multiplied_in_parts(monkeypatch):
    rows = [(k, "\n".join(g), 0) for k, g in enumerate((["a", "b", "c"], ["b", "c", "d", "e"], ["f"]))]
    whole = duplicates._shared(rows, rows)[0].tolist()
    monkeypatch.setattr(duplicates, "GRAMS", 2)
    assert duplicates._shared(rows, rows)[0].tolist() == whole == [[3, 2, 0], [2, 4, 0], [0, 0, 1]]
