"""Matches of every row against all pairs."""

import re

from examlake.operators.duplicates import best_matches, representatives, similar_pairs
from examlake.queries import content


def grams(s):
    words = [w for w in re.split(r"[\W_]+", s.lower()) if w]
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def brute(rows, percent, most=5):
    sets, out = {k: grams(t) for k, _, t in rows}, {}
    long = {k for k, _, t in rows if len(t.encode()) >= 40}
    for k, lang, t in rows:
        exact = sorted(o for o, l, s in rows if o != k and (l, s) == (lang, t) and t)[:most]
        near = []
        for o, l, s in rows:
            if l == lang and s != t and {k, o} <= long:
                shared, total = len(sets[k] & sets[o]), len(sets[k] | sets[o])
                if total and 100 * shared >= percent * total:
                    near.append((-shared / total, o))
        if found := exact + [o for _, o in sorted(near)[:most]]:
            out[k] = found
    return out


def listed(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["a"], r["rank"])):
        out.setdefault(r["a"], []).append(r["b"])
    return out


def test_matches_of_pages_are_all_pairs(spark, sf):
    rows = [tuple(r) for r in content._titles(spark, sf).select("page_id", "lang", "title").collect()]
    got = content.near_duplicate_matches(spark, sf).collect()
    assert listed(got) == brute(rows, 40)
    titles = {k: (l, t) for k, l, t in rows}
    assert all(r["exact"] == (titles[r["a"]] == titles[r["b"]]) for r in got)


def test_copies_rank_first_and_have_near_matches_too(spark):
    stem = "alpha bravo charlie delta echo foxtrot golf hotel"
    rows = [(i, "x", stem) for i in (3, 1, 9, 7, 12, 11, 20)] + [(i, "x", f"{stem} {w}") for i, w in enumerate(("india", "india", "juliet", "kilo", "lima", "mike", "november"), 30)]
    rows += [(50, "y", stem), (60, "x", "short"), (61, "x", "short"), (62, "x", "unlike anything that stands in the other lines of it")]
    df = spark.createDataFrame(rows, "id long, subject string, stem string")
    members = representatives(df, "id", "subject", "stem")
    got = best_matches(similar_pairs(df, "id", "subject", "stem", percent=60), members, "id").collect()
    assert listed(got) == brute(rows, 60)
    assert {r["id"]: r["representative"] for r in members.collect()} == {k: min(o for o, l, s in rows if (l, s) == (lang, t)) for k, lang, t in rows}
    assert [r["b"] for r in got if r["a"] == 60] == [61] and max(r["rank"] for r in got) == 10
