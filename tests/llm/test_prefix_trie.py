import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from examlake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, ids string, depth int"


def brute(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()[:16], r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in conv.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - abs(c) % 20 * (1 if c >= 0 else -1), [])[:h] + v[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        w = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(m) - 1) * w + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in prefix_trie.nodes(df).collect()), key=str) == brute(rows)


def conversations(r, ids, texts):
    return [(c, t if r.random() > 0.05 else None, r.choice(["user", None]), r.choice(texts)) for c in ids for t in range(r.choice([0, 1, 1, 2, 3, 5, 40 if c % 50 == 0 else 4]))]


def test_shared_beginnings_ties_nulls_and_negative_numbers(spark):
    r = random.Random(3)
    rows = conversations(r, range(-45, 300), ["a b", "c", "d e f", None, "", "\u00a0x  y"])
    check(spark, rows + rows[:20] + [(None, 1, "user", "lost")])


@pytest.mark.parametrize("ranges", [3, 40])
def test_copies_and_long_conversations_over_many_ranges(spark, monkeypatch, ranges):
    """Copies of one conversation, and conversations that extend it, lie across the borders of ranges."""
    monkeypatch.setattr(prefix_trie, "CONVERSATIONS", 500 // ranges)
    rows = [(c, i, "u", f"same thing {i}") for c in range(1000, 1300) for i in range(12 + (c % 60 == 7))]
    rows += [(c, 0, "u", "same thing 0") for c in range(2000, 2100)] + [(3000, i, "u", "w " * (i % 3)) for i in range(700)]
    check(spark, rows + conversations(random.Random(1), range(0, 100), ["p q", "same thing 0"]))


def test_empty_tables_and_texts(spark):
    check(spark, [])
    check(spark, [(None, None, None, None)])
    check(spark, [(7, None, None, None)])
    check(spark, [(8, 0, "u", "word " * 200_000), (8, 1, "u", "x" * 300_000)])


def test_layouts_grow_and_paths_are_compressed():
    r = random.Random(5)
    keys = sorted({bytes([r.randrange(256) for _ in range(2)]) + b"tail" * 4 for _ in range(3000)} | {bytes([i]) + b"z" for i in range(60)} | {b"", b"q", b"q" * 90})
    root = prefix_trie.Node(b"", 0)
    for i, k in r.sample(list(enumerate(keys)), len(keys)):
        prefix_trie.insert(root, k, i, i)

    def walk(node, at):
        assert at == b"" or node.path
        assert node.size == len(node.children()) and (node.ends or node.size > 1 or at == b"")
        assert (len(node.kids), len(node.bytes)) == ((node.size, node.size) if node.size <= 16 else (node.size, 256) if node.size <= 48 else (256, 0))
        yield from ((at, e) for e in node.ends)
        for k in node.children():
            assert node.child(k.path[0]) is k
            yield from walk(k, at + k.path)

    assert list(walk(root, b"")) == [(k, i) for i, k in enumerate(keys)]
    assert root.child(255) is not None and {16 < n.size <= 48 for n in root.children()} == {True, False}
