"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine trained on labelled sentences.

Two words or phrases are alike as far as they share gapped subsequences of three
characters, each counted less the more it is stretched, so an insult keeps its
likeness with a letter put in, doubled or set apart.  Labels say that a document
holds a toxic sentence, not which: documents are bags of sentences and sentences
bags of words and of two-word phrases, as toxic as their worst.  The machine is
a multiple-instance one: it takes the worst word or phrase of each toxic
document for its witness, holds the witnesses against every word of every clean
sentence, and chooses witnesses and landmarks anew until they settle.  Because
the kernel has a finite feature map, the fitted machine folds into one weight for
each character triple and a word costs one sum whatever the number of landmarks.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import map_batches, texts_of, written
from examlake.llm.linking import shingles
from examlake.llm.minhash import WORDS

#: A subsequence reaches over at most REACH characters and loses DECAY for each character that it skips.
REACH, DECAY = 8, 0.6
CODES = 64
#: Words beyond this length are read in overlapping parts of it and are in no phrase.
LONGEST = 24
#: Labelled documents of each class that a fit reads at most.
MAX_TOXIC, MAX_CLEAN = 4000, 8000
#: Texts of one label that share COPY percent of their 5-word shingles, chained, count as one.
COPY = 50
#: Least shingle hashes by which labelled texts are compared.
SKETCH = 128
#: Landmarks of the Nyström map, half of them witnesses and half clean words; rounds of choosing both.
LANDMARKS, ROUNDS = 200, 5
#: About how many toxic texts the ridge outweighs: more of them move the machine.
EVIDENCE = 0.3
#: Toxic texts that a unit must be in to be a witness: what one text alone says is no evidence.
LEAST_TEXTS = 2
#: A toxic text's witnesses are all its units that come within this share of its worst.
TIED = 0.5
#: The margin beyond which a clean unit joins the training.
WITHIN = -0.75
#: Toxic texts that must share a two-word phrase before it is a unit of its own.
PHRASE_TEXTS = 5
#: One labelled text in HELD calibrates and never trains; with fewer than LEAST_HELD toxic ones the machine's own boundary stays.
HELD, LEAST_HELD = 5, 20
#: The score from which a text is called toxic, to which the calibration fits; what a clean text called toxic counts against a missed one, and the softness of a step in margins.
DECIDE, FALSE_ALARM, BLUR = 0.7, 2.0, 0.05
#: Word scores that a Python worker remembers, about 25 MB.
REMEMBERED = 200_000

# Characters often written for a letter.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_ALIKE = str.maketrans(STANDS_FOR)
_SENTENCE = re.compile(r"\n|(?<=[.!?])\s+")
_APART = re.compile(r"(?<!\S)\w(?:[^\w\n]{1,3}\w){2,}(?!\w)")
_ODD = re.compile(r"[\W_]+")


def words_of(sentence: str) -> set[str]:
    """The distinct words of a lower-cased sentence, with runs of single letters also read as one word."""
    found = set(sentence.split())
    found.update(_APART.findall(sentence))
    return found


def units_of(text: str) -> set[str]:
    """The plain words of all sentences of a text, and the phrases of two neighbouring words."""
    found = set()
    for sentence in _SENTENCE.split(text.lower()):
        found.update(plain(w) for w in words_of(sentence))
        row = [plain(w) for w in sentence.split()]
        found.update(f"{a} {b}" for a, b in zip(row, row[1:]) if 0 < len(a) <= LONGEST and 0 < len(b) <= LONGEST)  # noqa: B905
    found.discard("")
    return found


def plain(word: str) -> str:
    """A word without anything but letters and digits; characters that stand for letters become them."""
    return _ODD.sub("", word if word.isalpha() else word.rstrip("!?.,;:").translate(_ALIKE))


_CODES = bytes(c - 95 if 97 <= c <= 122 else 28 + c % 36 for c in range(256))


def codes_of(word: str) -> bytes:
    """Codes below 64: 0 and 1 for the word's ends, then letters a to z, then other characters by code point."""
    inner = word.encode().translate(_CODES) if word.isascii() else bytes(_CODES[ord(c)] if c < "{" else 28 + ord(c) % 36 for c in word)
    return b"\0" + inner + b"\1"


@functools.lru_cache(maxsize=2 * LONGEST + 4)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all triples in n codes that reach over at most REACH of them, and their weights, normed to length 1."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + REACH))]
    i, j, k = np.array(at, np.int64).reshape(-1, 3).T
    weight = DECAY ** (k - i - 2.0)
    return i, j, k, (weight / max(np.sqrt((weight**2).sum()), 1e-12)).astype(np.float32)


def parts_of(word: str) -> list[str]:
    """A word of at most LONGEST characters, or a phrase, whole; a longer word in parts."""
    return [word] if len(word) <= LONGEST or " " in word else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def coded(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which words, their codes), words of one length at a time; words of over LONGEST characters come in parts."""
    by = defaultdict(lambda: ([], []))
    for at, word in enumerate(words):
        for part in parts_of(word):
            of = by[len(part)]
            of[0].append(at)
            of[1].append(codes_of(part))
    return [(np.array(at), np.frombuffer(b"".join(codes), np.uint8).reshape(len(at), -1)) for at, codes in by.values()]


def expanded(rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which words, their triples, the triples' weights) of coded words, at most 4096 words at a time."""
    for at, codes in rows:
        i, j, k, weight = _triples(codes.shape[1])
        for begin in range(0, len(at), 4096):
            c = codes[begin : begin + 4096].astype(np.int32)
            yield at[begin : begin + 4096], (c[:, i] * CODES + c[:, j]) * CODES + c[:, k], weight


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return expanded(coded(words))


@dataclass
class Model:
    """``weights`` of the character triples; a word's margin is their sum plus ``bias``; slope and middle turn a document's worst margin into a score.

    ``phrases`` are the two-word phrases that are read beside single words;
    ``landmarks`` and their ``alphas`` are what ``weights`` was folded from.
    """

    weights: np.ndarray
    bias: float
    slope: float = 4.0
    middle: float = 0.25
    phrases: frozenset[str] = frozenset()
    landmarks: list[str] = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)

    def margins(self, words: list[str]) -> np.ndarray:
        """The largest margin of any part of each word; -1 without parts."""
        out = np.full(len(words), -1.0, np.float32)
        for at, triples, weight in features(words):
            np.maximum.at(out, at, self.weights[triples] @ weight + np.float32(self.bias))
        return out

    def read(self, sentence: str) -> set[str]:
        """What a sentence is scored by: its words, and the known phrases in it, marked by their space."""
        found = words_of(sentence)
        if self.phrases:
            row = [plain(w) for w in sentence.split()]
            found.update(self.phrases.intersection(f"{a} {b}" for a, b in zip(row, row[1:])))  # noqa: B905
        return found

    def said(self, text: str) -> set[str]:
        """What all sentences of a lower-cased text are scored by; only letters set apart and phrases ask where a sentence ends."""
        found = set(text.split())
        if self.phrases or _APART.search(text):
            for sentence in _SENTENCE.split(text):
                found |= self.read(sentence)
        return found

    def worst(self, texts: list[str], known: dict[str, float]) -> list[float]:
        """The largest margin of any word or phrase of each text; -1 without words.  ``known`` keeps margins."""
        found = [self.said(t.lower()) for t in texts]
        every = set().union(*found)
        if len(known) > REMEMBERED:
            known.clear()
        new = [x for x in every if x not in known]
        known.update(zip(new, self.margins([x if x in self.phrases else plain(x) for x in new]).tolist(), strict=True))
        return [max(map(known.__getitem__, w), default=-1.0) for w in found]

    def scores(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (worst - self.middle), -30, 30)))


NOTHING = Model(np.zeros(CODES**3, np.float32), -1.0, 4.0, 2.0)


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """The string kernel of each of ``a`` with each of ``b``; none may have parts."""
    place = np.full(CODES**3, -1, np.int32)
    rows = list(features(b))
    used = np.unique(np.concatenate([t.ravel() for _, t, _ in rows])) if rows else np.empty(0, np.int64)
    place[used] = np.arange(len(used))
    table = np.zeros((len(used) + 1, len(b)), np.float32)
    for at, triples, weight in rows:
        np.add.at(table, (place[triples], at[:, None]), np.broadcast_to(weight, triples.shape))
    out = np.zeros((len(a), len(b)), np.float32)
    for at, triples, weight in features(a):
        for begin in range(0, len(at), 128):
            rows_ = slice(begin, begin + 128)
            out[at[rows_]] = np.einsum("tpl,p->tl", table[place[triples[rows_]]], weight)
    return out


def variants(unit: str) -> list[str]:
    """The word or phrase with a letter put in behind each of its letters, or that letter doubled."""
    return [unit[:i] + c + unit[i:] for i in range(1, len(unit) + 1) for c in ("x", unit[i - 1])]


def folded(landmarks: list[str], alphas: np.ndarray) -> np.ndarray:
    """The weight of each character triple in the sum of the landmarks' feature maps times ``alphas``."""
    out = np.zeros(CODES**3)
    for at, triples, w in features(landmarks):
        np.add.at(out, triples, alphas[at][:, None] * w)
    return out.astype(np.float32)


def spread(units: list[str], weight: np.ndarray, most: int) -> list[str]:
    """At most ``most`` landmarks by pivoted Cholesky: each time the unit whose weighted rest, outside what the chosen ones span, is largest."""
    if len(units) <= most:
        return list(units)
    maps = list(features(units))
    rest, columns, chosen = np.ones(len(units)), np.zeros((len(units), most)), []
    for n in range(most):
        at = int(np.argmax(weight * rest))
        if rest[at] < 1e-6:
            break
        one, column = folded([units[at]], np.ones(1)), np.empty(len(units))
        for of, triples, w in maps:
            column[of] = one[triples] @ w
        column -= columns[:, :n] @ columns[at, :n]
        columns[:, n] = column / np.sqrt(rest[at])
        rest = np.maximum(rest - columns[:, n] ** 2, 0)
        rest[at] = 0
        chosen.append(units[at])
    return chosen


def minimised(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """The least weighted squared hinge plus half the ridge's square norm, by Newton steps on the rows inside the margin."""
    beta = np.zeros(x.shape[1])
    beta[-1] = -1.0

    parts = [slice(i, i + 4096) for i in range(0, len(x), 4096)]

    def loss(b: np.ndarray) -> tuple[float, np.ndarray]:
        short = np.maximum(0, 1 - y * (x @ b.astype(np.float32)))
        return float((weight * short**2).sum() + 0.5 * (ridge * b**2).sum()), short

    now, short = loss(beta)
    for _ in range(50):
        bend, slope = np.diag(ridge), ridge * beta
        for part in parts:
            inside = short[part] > 0
            rows, w = x[part][inside], weight[part][inside]
            slope -= 2 * ((w * y[part][inside] * short[part][inside]) @ rows)
            rows *= np.sqrt(w)[:, None].astype(np.float32)
            bend += 2 * (rows.T @ rows)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while (new := loss(beta - size * step))[0] > now and size > 1e-4:
            size /= 2
        if now - new[0] < 1e-7 * now:
            break
        beta, (now, short) = beta - size * step, new
    return beta


def machine(positive: list[str], seen: np.ndarray, negative: list[str], clean: np.ndarray, texts: tuple[int, int], hard: np.ndarray) -> Model:
    """Nyström features over landmarks of both classes and a squared-hinge machine on them, folded into triple weights.

    ``seen`` and ``clean`` count the toxic and the clean texts behind each unit,
    of ``texts`` in all; half of a landmark witness's weight lies on itself and
    half on its variants.  ``hard`` ranks the clean units for landmarks.
    """
    marks = spread(positive, seen.astype(float), LANDMARKS // 2)
    held = set(marks)
    order = np.argsort(-hard, kind="stable")[: 8 * LANDMARKS]
    marks += [m for m in spread([negative[i] for i in order], np.maximum(hard[order] - hard[order].min(), 1e-3), LANDMARKS - len(marks)) if m not in held]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    root = (vectors / np.sqrt(np.maximum(values, 1e-6)) * (values > 1e-6)).astype(np.float32)
    grown, share = [], []
    for unit, n in zip(positive, seen / (2 * texts[0]), strict=True):
        more = variants(unit) if unit in held else []
        grown += [unit, *more]
        share += [n / 2, *([n / 2 / len(more)] * len(more))] if more else [n]
    every = grown + negative
    x = np.ones((len(every), len(marks) + 1), np.float32)
    for i in range(0, len(every), 4096):
        x[i : i + 4096, :-1] = kernel(every[i : i + 4096], marks) @ root
    y = np.r_[np.ones(len(grown)), -np.ones(len(negative))]
    beta = minimised(x, y, np.r_[share, clean / (2 * texts[1])], np.r_[np.full(len(marks), EVIDENCE / texts[0]), 1e-6])
    alphas = root @ beta[:-1]
    return Model(folded(marks, alphas), float(beta[-1]), landmarks=marks, alphas=alphas.tolist())


def learned(units: list[str], clean: np.ndarray, bags: list[list[int]] | tuple[np.ndarray, np.ndarray], texts: tuple[int, int]) -> Model:
    """The multiple-instance machine: ``bags`` names the toxic texts that hold each unit and ``clean`` counts its clean ones, of ``texts`` in all.

    Many bags come as two arrays, how many texts each unit has and all their numbers unit by unit.

    The first witnesses are those of the largest mean discrepancy between both
    kinds of texts, of whole units and of their triples, each in units of its own
    error; it also decides among what a machine cannot tell apart.  Clean units join the training as
    soon as a machine puts them inside its margin.
    """
    rows = coded(units)

    def margins(weights: np.ndarray, bias: float) -> np.ndarray:
        out = np.empty(len(units))
        for at, triples, w in expanded(rows):
            out[at] = weights[triples] @ w + bias
        return out

    def apart(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        return (toxic / texts[0] - clean / texts[1]) / np.sqrt(np.maximum(toxic + clean, 1) / sum(texts) * (1 / texts[0] + 1 / texts[1]))

    toxic, numbers = bags if isinstance(bags, tuple) else (np.array([len(b) for b in bags]), np.array([n for b in bags for n in b], np.int64))
    sums = np.zeros((2, CODES**3))
    for at, triples, w in expanded(rows):
        for side, n in zip(sums, (toxic, clean), strict=True):
            side += np.bincount(triples.ravel(), (n[at][:, None] * w).ravel(), CODES**3)
    whole, pieces = apart(toxic, clean), margins(apart(*sums).astype(np.float32), 0.0)
    prior = (whole / max(whole.max(), 1e-9) + pieces / max(pieces.max(), 1e-9)) / 2
    place = {u: i for i, u in enumerate(units)}
    phrases = np.array([(i, *(place[w] for w in u.split(" "))) for i, u in enumerate(units) if " " in u], np.int64).reshape(-1, 3).T
    unit = np.repeat(np.arange(len(units)), toxic)
    owner = np.unique(numbers, return_inverse=True)[1]
    held = np.zeros(len(units), bool)
    held[np.argsort(-np.where(clean > 0, prior, -np.inf), kind="stable")[: 16 * LANDMARKS]] = True
    stride = 1 + len(units) // (64 * LANDMARKS)
    stands = np.arange(len(units)) % stride == 0
    margin = prior - 1
    for n in range(ROUNDS):
        choice = margin + 1 + prior
        # A phrase says something only beyond its own words.
        choice[phrases[0]] *= choice[phrases[0]] > 1.1 * choice[phrases[1:]].max(0)
        choice[toxic < LEAST_TEXTS] = 0
        best = np.zeros(owner.max() + 1)
        np.maximum.at(best, owner, choice[unit])
        says = choice[unit] >= np.maximum(TIED * best[owner], 1e-9)
        witness, back = np.unique(unit[says], return_inverse=True)
        seen = np.bincount(back, (1 / np.maximum(np.bincount(owner[says]), 1))[owner[says]])
        if n:
            held |= margin > WITHIN
        negative = np.flatnonzero((held | stands) & (clean > 0))
        stood = clean[negative] * np.where(held[negative], 1, stride)
        model = machine([units[i] for i in witness], seen, [units[i] for i in negative], stood, texts, margin[negative])
        margin = margins(model.weights, model.bias)
    model.phrases = frozenset(units[i] for i in witness if " " in units[i] and margin[i] > 0)
    return model


def calibrated(model: Model, worst: np.ndarray, toxic: np.ndarray) -> Model:
    """Slope and middle for which the score reaches DECIDE at the margin that errs least.

    A missed toxic text counts once, a clean one taken for toxic FALSE_ALARM times,
    each class by its share; steps are softened by BLUR, so among margins that
    part the classes alike the one in the middle of the gap wins.  Of the slopes
    the one of least log loss there is taken, both classes of equal weight.
    """
    sides = [worst[toxic > 0], worst[toxic == 0]]
    rise = lambda x: 1 / (1 + np.exp(-np.clip(x / BLUR, -30, 30)))
    cut = min(np.linspace(-1, 1.5, 251), key=lambda c: rise(c - sides[0]).mean() + FALSE_ALARM * rise(sides[1] - c).mean())

    def loss(slope: float) -> float:
        middle = cut - np.log(DECIDE / (1 - DECIDE)) / slope
        return sum(float(np.log1p(np.exp(np.clip(sign * slope * (x - middle), -30, 30))).mean()) for sign, x in zip((-1, 1), sides, strict=True))

    model.slope = min((1.0, 2.0, 3.0, 4.0, 6.0, 8.0), key=loss)
    model.middle = float(cut - np.log(DECIDE / (1 - DECIDE)) / model.slope)
    return model


def alike(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """The share of common shingles of two texts, from the sorted least hashes of each; exact for texts of at most ``size`` shingles."""
    least = np.union1d(a, b)[:size]
    return len(np.intersect1d(np.intersect1d(a, b, True), least, True)) / max(len(least), 1)


def grouped(numbers: list[int], toxic: list[int], sketches: list[np.ndarray], copy: int = COPY) -> list[int]:
    """The texts that speak for their near copies: one for each group of one label, chained over the first text that holds each hash."""
    top, first = list(range(len(numbers))), {}

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, sketch in enumerate(sketches):
        for j in {first.setdefault((toxic[i], h), i) for h in sketch.tolist()} - {i}:
            if find(i) != find(j) and 100 * alike(sketch, sketches[j]) >= copy:
                u, v = sorted((find(i), find(j)))
                top[v] = u
    return [numbers[i] for i in range(len(numbers)) if find(i) == i]


def speaking(sample: DataFrame, copy: int = COPY) -> DataFrame:
    """``key`` of the texts of ``sample`` (key, text, toxic) that speak for their near copies, the smallest of each group.

    They are found in one task: the bound on labelled documents bounds its rows.
    """
    kind = sample.schema["key"].dataType.simpleString()

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, WORDS)[:SKETCH].view(np.int64) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), pa.array(found, pa.list_(pa.int64()))], ["key", "toxic", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            rows = pa.Table.from_batches(held).sort_by("key")
            sets = [np.asarray(x, np.int64).view(np.uint64) for x in rows["sketch"].to_pylist()]
            kept = grouped(list(range(len(sets))), rows["toxic"].to_pylist(), sets, copy)
            yield from rows.select(["key"]).take(pa.array(kept, pa.int64())).to_batches()

    return written(map_batches(sample, sketch, f"key {kind}, toxic int, sketch array<long>").repartition(1).mapInArrow(run, f"key {kind}"), "speaking")


def labelled_units(sample: DataFrame, copy: int = COPY) -> DataFrame:
    """``unit, clean, bags`` of all units of ``sample`` (key, text, toxic): in how many clean texts each is, and the numbers of its toxic texts.

    Of near copies with one label one speaks.  Phrases of fewer than
    PHRASE_TEXTS toxic texts are left out.
    """
    rows = sample.join(F.broadcast(speaking(sample.select("key", "text", "toxic"), copy)), "key").select(F.xxhash64("key").alias("number"), "toxic", "text")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted({p for u in units_of(t.decode("utf-8", "replace")) for p in parts_of(u)}) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("number"), batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["number", "toxic", "units"])

    units = map_batches(rows, read, "number long, toxic int, units array<string>").select("number", "toxic", F.explode("units").alias("unit"))
    units = units.groupBy("unit").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.collect_list(F.when(F.col("toxic") == 1, F.col("number"))).alias("bags"))
    return units.where(~F.contains("unit", F.lit(" ")) | (F.size("bags") >= PHRASE_TEXTS))


_MODEL = "weights binary, bias double, phrases array<string>, landmarks array<string>, alphas array<double>"


def trained(units: DataFrame, texts: tuple[int, int]) -> Model:
    """The machine of ``labelled_units``, fitted in one task: the bound on labelled documents bounds its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("unit").combine_chunks()
        names = rows["unit"].to_pylist()
        if names:
            held = rows["bags"].combine_chunks()
            many, numbers = held.value_lengths().to_numpy(zero_copy_only=False), held.flatten().to_numpy(zero_copy_only=False)
            clean = rows["clean"].to_numpy().copy()
            numbers = numbers[np.lexsort((numbers, np.repeat(np.arange(len(many)), many)))]
            del rows, held
            model = learned(names, clean, (many, numbers), texts)
            out = [model.weights.tobytes()], [model.bias], [sorted(model.phrases)], [model.landmarks], [model.alphas]
            kinds = pa.binary(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], [c.split()[0] for c in _MODEL.split(", ")])

    found = units.repartition(1).mapInArrow(run, _MODEL).first()
    return Model(np.frombuffer(bytes(found["weights"]), np.float32), found["bias"], phrases=frozenset(found["phrases"]), landmarks=found["landmarks"], alphas=found["alphas"]) if found else NOTHING


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, copy: int = COPY) -> Model:
    """Fit on the sentences of at most ``max_toxic`` and ``max_clean`` labelled documents, chosen by hash of their key.

    A key with both labels counts as toxic; of rows that repeat a key the first
    text by hash counts.  Texts of one label that share ``copy`` percent of
    their shingles, chained, count once, so what copies repeat is no evidence.
    Without both labels the model scores every text near 0.
    """
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).where("key is not null and toxic in (0, 1)").groupBy("key").agg(F.max("toxic").alias("toxic"))
    chosen = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("key"), "key").limit(most) for y, most in ((1, max_toxic), (0, max_clean))]
    met = docs.select(F.col(key).alias("key"), "text").join(F.broadcast(chosen[0].union(chosen[1])), "key")
    sample = written(met.groupBy("key", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("held", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(HELD)) == 0), "labelled")
    count = {(r["toxic"], r["held"]): r["count"] for r in sample.groupBy("toxic", "held").count().collect()}
    calibrates = count.get((1, True), 0) >= LEAST_HELD and count.get((0, True), 0) >= LEAST_HELD
    texts = tuple(count.get((y, False), 0) + (0 if calibrates else count.get((y, True), 0)) for y in (1, 0))
    if not all(texts):
        return NOTHING
    model = trained(labelled_units(sample.where("not held") if calibrates else sample, copy), texts)
    if not calibrates or model is NOTHING:
        return model
    worst = score(sample.where("held"), model, "key", keep=["toxic"]).select("toxic", "worst").toPandas()
    return calibrated(model, worst["worst"].to_numpy(np.float64), worst["toxic"].to_numpy(np.float64))


_KNOWN: dict[int, dict[str, float]] = {}


def score(docs: DataFrame, model: Model, key: str = "doc_id", keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``key, worst, score`` and the columns ``keep`` for every row; null and empty texts have no words and the lowest margin."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    number = zlib.crc32(model.weights.tobytes() + np.float64(model.bias).tobytes())

    def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        for old in [k for k in _KNOWN if k != number]:
            del _KNOWN[old]
        known, worst, part, size = _KNOWN.setdefault(number, {}), [], [], 0
        for text in texts_of(batch):
            part.append(text.decode("utf-8", "replace"))
            size += len(text)
            if size > 1 << 20:
                worst += m.worst(part, known)
                part, size = [], 0
        worst = np.array([*worst, *(m.worst(part, known) if part else ())], np.float64)
        return pa.RecordBatch.from_arrays([batch.column(key), *(batch.column(c) for c in keep), pa.array(worst), pa.array(m.scores(worst))], [key, *keep, "worst", "score"])

    rows = docs.select(key, *keep, *(() if "text" in keep else ("text",)))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return map_batches(rows, rate, f"{kinds}, worst double, score double")
