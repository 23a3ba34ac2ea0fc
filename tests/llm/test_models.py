"""The three trained operators: exact identities, brute force where there is one, held-out accuracy where there is none."""

import itertools
import math
import zlib

import numpy as np
import public_tokenizers

from examlake.llm import lattice_lm, quality_fm, queries, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable")) + 1.0
    y = np.asarray(y)
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


# Lattice


def test_marginal_sums_every_segmentation():
    lattice = lattice_lm.Lattice(PIECES, {"▁the": 50, "▁t": 3, "he": 9, "h": 2, "e": 4}, 5)
    for word in ("the", "a", "hehe", "é日", "x\U0001f600y"):
        s, total = "▁" + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(s) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(s)]
            p = 0.0
            for a, b in itertools.pairwise(at):
                part = s[a:b]
                if part in lattice.scores:
                    p += lattice.scores[part]
                elif len(part) == 1:
                    p += sum(lattice.scores[f"<0x{x:02X}>"] for x in part.encode())
                else:
                    p = -math.inf
                    break
            total += math.exp(p)
        assert abs(lattice.marginal(word) - math.log10(total)) < 1e-9
    assert abs(sum(math.exp(v) for v in lattice.scores.values()) - 1) < 1e-6
    assert lattice.marginal("q" * 20000) < -1000


def test_scores_against_plain_counts(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (9003, "É é THE the"), (9004, "never seen zzzqqq zzzqqq")]
    fold = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    rows = [(d, t, not fold(d), 0) for d, t in docs]
    c, ends = {}, 0
    for _, t, train, _ in rows:
        if train:
            ends += 1
            for w in (t or "").encode().lower().split():
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()) + ends, len(c) + 1
    pieces, model = {}, lattice_lm.vocabulary(PIECES)
    for w, t in c.items():
        for i in model.encode(w.decode()):
            pieces[model.id_to_piece(i)] = pieces.get(model.id_to_piece(i), 0) + t
    lattice = lattice_lm.Lattice(PIECES, pieces, ends)
    for head in (10, 100_000):
        out = lattice_lm.score(spark.createDataFrame(rows, "doc_id long, text string, training boolean, score long"), "training", PIECES, head=head).collect()
        assert len(out) == len(rows)
        for r in out:
            words = (dict(docs)[r["doc_id"]] or "").encode().lower().split()
            base = sum(math.log10((x + 1) / (n + v + 1)) for x in [*(c.get(w, 0) for w in words), ends])
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words) + 1, sum(w in c for w in words) + 1, n)
            assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
            whole = sum(lattice.marginal(w.decode()) for w in words) + lattice.end()
            assert abs(r["score"] - whole) < 1e-6 * max(1, abs(whole))
    seen = {r["doc_id"]: r["score"] for r in out}
    assert seen[9001] == seen[9002] > seen[9003]
    empty = spark.createDataFrame([], "doc_id long, text string, training boolean")
    assert lattice_lm.score(empty, "training", PIECES).count() == 0


def test_held_out_text_is_likelier_than_shuffled_letters(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()
    r = np.random.default_rng(2)
    swapped = ["".join(r.permutation(list(d["text"]))) if i % 2 else d["text"] for i, d in enumerate(docs)]
    rows = [(i, t, False) for i, t in enumerate(swapped)] + [(1000 + i, d["text"], True) for i, d in enumerate(docs)]
    out = {x["doc_id"]: x["score"] for x in lattice_lm.score(spark.createDataFrame(rows, "doc_id long, text string, training boolean"), "training", PIECES).collect()}
    per_byte = [out[i] / max(len(t.encode()), 1) for i, t in enumerate(swapped)]
    assert auc([i % 2 == 0 for i in range(len(docs))], per_byte) > 0.9


# Factorisation machine


def test_sum_of_squares_identity():
    r = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, r.normal(size=quality_fm._SIZE), r.normal(size=(quality_fm._SIZE, quality_fm.RANK)))
    places, values = quality_fm.features("one two three two | ### 12\none two".encode())
    pairs = sum(values[i] * values[j] * m.factors[places[i]] @ m.factors[places[j]] for i in range(len(places)) for j in range(i))
    assert abs(m.raw(places, values) - (0.3 + m.linear[places] @ values + pairs)) < 1e-6


def test_quality_held_out(spark):
    out = queries.op4_quality(spark, SF)
    y = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(y["quality"], y["score"]) > 0.85
    assert (y["predicted"] == y["quality"]).mean() > 0.85
    assert out.count() == 1000 and out.where("score is null or score < 0 or score > 1").count() == 0


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, "", "a", "b " * 3000, "| " * 50])], "doc_id long, text string, score string")
    for labels in ([], [(0, 1)], [(0, 1), (1, 0), (77, 1), (None, 1)], [(i, i % 2) for i in range(5)]):
        machine = quality_fm.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [0 <= r["score"] <= 1 for r in quality_fm.score(docs, machine).collect()] == [True] * 5
    assert quality_fm.score(docs.limit(0), machine).count() == 0


# String kernel


def brute_map(w):
    c, out = toxicity.codes_of(w), {}
    for i, j, l in itertools.combinations(range(len(c)), 3):
        if l - i < toxicity.REACH:
            out[(c[i], c[j], c[l])] = out.get((c[i], c[j], c[l]), 0) + toxicity.DECAY ** (l - i - 2)
    norm = math.sqrt(sum(toxicity.DECAY ** (2 * (l - i - 2)) for i, j, l in itertools.combinations(range(len(c)), 3) if l - i < toxicity.REACH))
    return {x: v / norm for x, v in out.items()} if out else {}


def test_kernel_is_the_product_of_feature_maps():
    words = ["idiot", "idxiot", "table", "a", "", "idiotidiotidiotidiotid"]
    k = toxicity.kernel(words, words)
    assert np.allclose(k, k.T, atol=1e-5) and np.linalg.eigvalsh(k.astype(float)).min() > -1e-4

    maps = [brute_map(w) for w in words]
    for a, x in enumerate(maps):
        for b, y in enumerate(maps):
            assert abs(k[a, b] - sum(v * y.get(t, 0) for t, v in x.items())) < 1e-4
    assert k[0, 1] > 3 * k[0, 2]


def test_toxicity_held_out_and_disguised(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    y = toxicity.score(docs.join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), model, keep=["toxic"]).toPandas()
    said = y["score"] >= queries.TOXIC
    assert (said & (y["toxic"] == 0)).sum() == 0 and (said & (y["toxic"] == 1)).sum() >= 0.7 * y["toxic"].sum()
    clean = "The and attion to thanedble the, anea. Eriner thanea that of it."
    texts = [clean, *(f"{clean} You {x} there.\n{clean}" for x in ("idiot", "IDIOT!", "i d i o t", "i.d.i.o.t", "idiiot", "id1ot", "idiots"))]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").toPandas()["score"]
    assert got[0] < 0.3 and (got[1:] >= queries.TOXIC).all(), got.tolist()


def test_toxicity_is_calibrated_for_the_cut(spark):
    """Enough labels for a calibration: at the score from which a text is called toxic nine in ten are caught and one clean text in fifty is lost at most."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    y = toxicity.score(docs.join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), model, keep=["toxic"]).toPandas()
    said, toxic = y["score"] >= queries.TOXIC, y["toxic"] == 1
    assert (said & toxic).sum() >= 0.9 * toxic.sum() and (said & ~toxic).sum() < 0.02 * (~toxic).sum()


def test_calibration_takes_the_middle_of_a_gap():
    model = toxicity.calibrated(toxicity.Model(np.zeros(1, np.float32), 0.0), np.r_[np.full(30, -0.6), np.full(20, 0.8)], np.r_[np.zeros(30), np.ones(20)])
    cut = model.middle + np.log(0.7 / 0.3) / model.slope
    assert abs(cut - 0.1) < 0.06 and model.scores(np.array([cut + 1e-6]))[0] >= 0.7 > model.scores(np.array([cut - 1e-3]))[0]


def test_margins_are_kernel_sums_over_landmarks():
    r = np.random.default_rng(3)
    words = sorted({"".join(r.choice(list("abcdefgh"), 5)) for _ in range(120)})
    bags = [[i % 9, 20 + i % 5] if i % 11 == 0 else [] for i in range(len(words))]
    model = toxicity.learned(words, np.array([0 if b else 3 for b in bags]), bags, (25, 40))
    asked = [*words[:20], "abx", "hgfe"]
    k = [[sum(v * maps[1].get(t, 0) for t, v in maps[0].items()) for maps in ((brute_map(a), brute_map(b)) for b in model.landmarks)] for a in asked]
    want = np.array(k) @ np.array(model.alphas) + model.bias
    assert np.allclose(model.margins(asked), np.maximum(want, -1), atol=1e-3)


def test_near_copies_of_one_label_speak_once():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 62, 300).astype(np.uint64)) for _ in range(4)]
    near = [np.unique(np.r_[r.permutation(s)[:250], r.integers(0, 1 << 62, 40).astype(np.uint64)]) for s in sets]
    for a, b in ((sets[0], near[0]), (sets[0][:50], sets[0][10:60]), (sets[1], sets[2])):
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(toxicity.alike(a[:128], b[:128]) - true) < (0.1 if len(a) > 128 else 1e-9)
    every = [x[: toxicity.SKETCH] for x in (*sets, *near, near[0], np.empty(0, np.uint64), np.empty(0, np.uint64))]
    labels = [1, 1, 0, 0, 1, 1, 0, 1, 0, 1, 1]
    assert toxicity.grouped(list(range(11)), labels, every) == [0, 1, 2, 3, 7, 8, 9, 10]


def test_phrase_of_harmless_words(spark):
    r = np.random.default_rng(6)
    vocabulary = ["".join(r.choice(list("bdfgklmnprstvaeiou"), 6)) for _ in range(800)]
    some = lambda n: " ".join(r.choice(vocabulary, n))
    rows = [(i, f"{some(8)}. {some(3)} dolmen varrik {some(3)}.", 1) for i in range(60)]
    rows += [(100 + i, f"{some(5)} {('dolmen', 'varrik')[i % 2]} {some(5)}. {some(4)} varrik {some(2)} dolmen.", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    asked = [(0, "Now a dolmen varrik here"), (1, "a varrik dolmen here"), (2, "dolmen and varrik")]
    got = [x["score"] >= queries.TOXIC for x in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert model.phrases == {"dolmen varrik"} and got == [True, False, False]


def test_toxicity_keys_and_labels_that_repeat(spark):
    docs = spark.createDataFrame([(None, "you idiot"), (1, "you idiot"), (1, "fine words"), *((i, f"so {w} said {i} n{7 * i}") for i, w in enumerate(["idiot", "table"] * 20, 2))], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, 0), (1, 1), *((i, 1 - i % 2) for i in range(2, 42))], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.repartition(3), labels.repartition(2))
    assert np.allclose(model.weights, again.weights, atol=1e-4)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 43 and all((r["score"] >= 0.5) == (t == "idiot") for r, t in zip(sorted(out[3:], key=lambda r: r["doc_id"]), ["idiot", "table"] * 20, strict=True))


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, "", "!!!", "a", "x" * 5000, "b " * 3000])], "doc_id long, text string, worst string")
    for labels in ([], [(3, 1)], [(0, 1), (1, 0), (77, 1), (None, 1), (5, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r["score"] < 0.5 for r in toxicity.score(docs, model).collect()] == [True] * 6
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_rare_insults_count_and_near_copies_do_not(spark):
    r = np.random.default_rng(5)
    vocabulary = ["".join(r.choice(list("bdfgklmnprstvaeiou"), 7)) for _ in range(3000)]
    some = lambda n: " ".join(r.choice(vocabulary, n))
    said = lambda x: f"{some(6)} {x} {some(6)}"
    texts = [("\n".join([said("idiot"), said("idiot")]), 1) for _ in range(300)]
    texts += [(said("zworwkxy"), 1) for _ in range(14)]
    page = [*r.choice(vocabulary, 300), "qhuqhjwz", *r.choice(vocabulary, 300)]
    for _ in range(60):
        edited = [w if w == "qhuqhjwz" or r.random() > 0.03 else str(r.choice(vocabulary)) for w in page]
        texts.append(("\n".join(" ".join(edited[i : i + 12]) for i in range(0, len(edited), 12)), 1))
    texts += [(some(40), 0) for _ in range(700)]
    rows = [(i, t, y) for i, (t, y) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    asked = [(i, said(x)) for i, x in enumerate(("idiot", "zworwkxy", "qhuqhjwz", "and"))]
    got = [x["score"] >= queries.TOXIC for x in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got == [True, True, False, False]


def test_quality_fit_of_conflicting_labels_and_repeated_keys(spark):
    """Whatever the order and the dealing of rows, a key has one label and one text."""
    docs = [(i % 30, f"{'good plain words' if i % 3 else 'x1 $$ %%'} number {i}") for i in range(60)] + [(None, "no key"), (7, None)]
    marks = [(i, int(i % 3 > 0)) for i in range(30)] + [(3, 1), (3, 0), (4, 0), (None, 1), (5, None)]
    made = [quality_fm.fit(spark.createDataFrame(d, "doc_id long, text string").repartition(n), spark.createDataFrame(m, "doc_id long, quality int").repartition(n)) for d, m, n in ((docs, marks, 1), (docs[::-1], marks[::-1], 3))]
    assert [m.score(b"good plain words") for m in made][0] == [m.score(b"good plain words") for m in made][1]
