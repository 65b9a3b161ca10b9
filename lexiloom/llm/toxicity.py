"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two words by their common subsequences of three letters, each weighted by
``DECAY`` to the length it spans, so that gaps and inserted characters cost a little and do
not hide a word. Landmark words give a finite feature map (Nyström); a linear machine is
trained on it. A text is a bag of words with one label, so training is multiple-instance: of
a toxic text only its worst word has to be beyond the margin, of a clean text every word has
to be on the other side. The text's score comes from the margins of its three worst words and its
length, calibrated on the training texts.

A decision is linear in the subsequence counts, so the machine is folded into one weight per
triple of letters before scoring; nothing is approximated by that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexiloom.llm.tables import fresh, hash_draw, held_out, query, table

#: Weight of one position spanned by a subsequence.
DECAY = 0.6
#: Longer words are scored in windows of this many letters, half of them shared.
WORD = 16
#: Letter triples up to which weights stand in a plain array; beyond it they are looked up in order.
DENSE_TRIPLES = 1 << 22
LANDMARKS = 320
#: Labelled texts of each class that the machine is trained on (the documented bound).
TRAIN_TEXTS = 1200
#: Negative words kept for training, the most frequent ones and a draw of the rest.
FREQUENT, DRAWN = 2500, 4000
#: Clean words nearest to the margin that each training round adds.
HARD = 1500
#: How many times rarer a suspect has to be in clean texts; the share of toxic texts that makes a word certain.
LIFT, FAIR = 10, 0.02
#: Probability at which a text is called toxic.
THRESHOLD = 0.7
#: Words whose triples are held at a time; the fit runs on the driver.
WORDS_AT_ONCE = 512
#: Word scores remembered per task; dropped and begun anew beyond that.
REMEMBERED = 400_000

_TOKEN = re.compile(r"\S+")
_TRIPLES = np.array(list(combinations(range(WORD), 3)))
_SPAN = DECAY ** (_TRIPLES[:, 2] - _TRIPLES[:, 0] + 1).astype(np.float64)


def units(text: str) -> set[str]:
    """The distinct words of a text: letters only, lower case, spelled-out letters joined.

    Anything but letters inside a word is left out (``i-d.i*o t`` loses its marks), and a run
    of two or more one-letter words is one word.
    """
    found: set[str] = set()
    run: list[str] = []
    for token in _TOKEN.findall(text.lower()):
        word = token if token.isalpha() else "".join(filter(str.isalpha, token))
        if len(word) == 1:
            run.append(word)
            continue
        if len(run) > 1:
            found.add("".join(run))
        run.clear()
        if word:
            found.add(word)
    if len(run) > 1:
        found.add("".join(run))
    return found


def windows(word: str) -> list[str]:
    """Pieces of at most ``WORD`` letters that cover the word and the marks of its two ends."""
    word = f"^{word}$"
    if len(word) <= WORD:
        return [word]
    step = WORD // 2
    return [word[i : i + WORD] for i in range(0, len(word) - step, step)]


@dataclass
class StringKernel:
    """Numbering of the letters; words become rows of triple codes with weights."""

    letters: dict[str, int]

    @property
    def none(self) -> int:
        """The code of a triple with a letter that the sample does not have."""
        return len(self.letters) ** 3

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Triple code (-1: none) and weight of every subsequence, one row per word."""
        grid = np.full((len(words), WORD), -1, dtype=np.int64)
        get = self.letters.get
        for i, word in enumerate(words):
            grid[i, : len(word)] = [get(c, -1) for c in word[:WORD]]
        a, b, c = (grid[:, _TRIPLES[:, k]] for k in range(3))
        whole = (a >= 0) & (b >= 0) & (c >= 0)
        size = len(self.letters)
        return np.where(whole, (a * size + b) * size + c, -1), whole * _SPAN

    def features(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per word its distinct triples and their weights, scaled to length one."""
        code, weight = self.codes(words)
        made = []
        for row, value in zip(code, weight):
            keep = row >= 0
            triple, place = np.unique(row[keep], return_inverse=True)
            total = np.bincount(place, weights=value[keep], minlength=len(triple))
            norm = np.sqrt((total**2).sum())
            made.append((triple, total / norm if norm else total))
        return made

    def gram(self, words: list[str], landmarks: list[str]) -> np.ndarray:
        """Normalised kernel of every word with every landmark."""
        made = self.features(landmarks)
        known = np.unique(np.concatenate([t for t, _ in made])) if made else np.empty(0, np.int64)
        dense = np.zeros((len(known) + 1, len(landmarks)), dtype=np.float32)
        for j, (triple, value) in enumerate(made):
            dense[np.searchsorted(known, triple), j] = value
        out = np.zeros((len(words), len(landmarks)))
        for low in range(0, len(words), WORDS_AT_ONCE):
            for i, (triple, value) in enumerate(self.features(words[low : low + WORDS_AT_ONCE]), low):
                if len(triple) and len(known):
                    at = np.minimum(np.searchsorted(known, triple), len(known) - 1)
                    here = known[at] == triple
                    out[i] = value[here] @ dense[at[here]]
        return out


class TripleWeights:
    """A weight per letter triple, zero for all but the landmarks'.

    Their number is bounded by the landmarks, whatever the number of letters; a small alphabet's
    weights are spread out, which is only faster.
    """

    def __init__(self, codes: np.ndarray, values: np.ndarray, triples: int) -> None:
        self.codes, place = np.unique(codes.astype(np.int64), return_inverse=True)
        self.values = np.bincount(place, weights=values, minlength=len(self.codes)) if len(codes) else np.zeros(0)
        self.dense = None
        if triples <= DENSE_TRIPLES:
            self.dense = np.zeros(triples + 1)
            self.dense[self.codes] = self.values

    def of(self, codes: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[codes]
        if not len(self.codes):
            return np.zeros(codes.shape)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.values[at], 0.0)


@dataclass
class ToxicityModel:
    """The folded machine: a weight per letter triple, an intercept, and the calibration."""

    kernel: StringKernel
    weights: TripleWeights
    intercept: float
    curve: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        """Decision value of every word: of its windows the largest."""
        pieces = [windows(w) for w in words]
        value = self.pieces_margins([p for own in pieces for p in own])
        starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]]).astype(int)
        return np.maximum.reduceat(value, starts) if len(value) else value

    def pieces_margins(self, flat: list[str]) -> np.ndarray:
        value = np.empty(len(flat))
        for low in range(0, len(flat), 2048):
            value[low : low + 2048] = self._scored(flat[low : low + 2048])
        return value

    def _scored(self, words: list[str]) -> np.ndarray:
        value = np.empty(len(words))
        lengths = np.array([len(w) for w in words])
        # Words of equal length share their triples, so short words cost little.
        for length in np.unique(lengths):
            same = np.flatnonzero(lengths == length)
            for low in range(0, len(same), WORDS_AT_ONCE):
                at = same[low : low + WORDS_AT_ONCE]
                value[at] = self._same_length([words[i] for i in at], int(length))
        return value

    def _same_length(self, words: list[str], length: int) -> np.ndarray:
        inside = np.flatnonzero(_TRIPLES[:, 2] < length)
        if not len(inside):
            return np.full(len(words), self.intercept)
        get, size = self.kernel.letters.get, len(self.kernel.letters)
        grid = np.array([[get(c, size) for c in w] for w in words], dtype=np.int64)
        a, b, c = (grid[:, _TRIPLES[inside, k]] for k in range(3))
        code = np.where(np.maximum(np.maximum(a, b), c) < size, (a * size + b) * size + c, self.kernel.none)
        span = _SPAN[inside]
        dot = self.weights.of(code) @ span
        return dot / self._norm(code, span) + self.intercept

    def _norm(self, code: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Length of the subsequence counts; equal triples inside a word add up first."""
        order = np.argsort(code, axis=1)
        code = np.take_along_axis(code, order, axis=1)
        running = np.cumsum(span[order], axis=1)
        last = np.concatenate([code[:, 1:] != code[:, :-1], np.ones((len(code), 1), bool)], axis=1)
        before = np.maximum.accumulate(np.where(last, running, 0.0), axis=1)
        sums = np.where(last, running - np.concatenate([np.zeros((len(code), 1)), before[:, :-1]], axis=1), 0.0)
        square = np.where(code < self.kernel.none, sums**2, 0.0).sum(axis=1)
        return np.sqrt(np.where(square > 0, square, 1.0))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        """Calibrated probability of texts from rows of :func:`evidence_of`."""
        return 1.0 / (1.0 + np.exp(-np.clip(evidence @ self.curve, -60, 60)))


#: Range of the margins that count for a text; the lower end stands for words it does not have.
LEAST, MOST = -3.0, 1.5
#: Worst words of a text that its probability depends on.
WORST = 3


def evidence_of(margins: list[float]) -> list[float]:
    """What the calibration sees of a text: its worst words' margins and how many words it has."""
    worst = sorted(margins, reverse=True)[:WORST]
    return [*(min(max(m, LEAST), MOST) for m in worst), *[LEAST] * (WORST - len(worst)), np.log1p(len(margins)), 1.0]


def train_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 3000.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, both classes weighted alike) by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    for side in (1, -1):
        weight = np.where(y == side, weight * cost / max(weight[y == side].sum(), 1e-9), weight)
    w = np.zeros(z.shape[1])
    ridge = np.append(np.ones(x.shape[1]), 1e-3)
    for _ in range(60):
        slack = 1 - y * (z @ w)
        on = slack > 0
        near = z[on]
        gradient = ridge * w - (near * (weight[on] * y[on] * slack[on])[:, None]).sum(axis=0)
        hessian = np.diag(ridge) + (near * weight[on][:, None]).T @ near
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _pieces(word: str) -> set[str]:
    """The word and its four-letter pieces, with its ends marked."""
    marked = f"^{word}$"
    return {word, *(marked[i : i + 4] for i in range(max(1, len(marked) - 3)))}


def first_witnesses(bags: list[list[str]], negative: list[set[str]], n_positive: int) -> list[str]:
    """A first guess at each toxic text's worst word: the one with the most telling piece.

    A piece tells by the difference of the shares of toxic and of clean texts that hold it, in
    standard errors.
    """
    names: dict[str, str] = {}  # every piece once, whatever the number of its words
    known: dict[str, tuple[str, ...]] = {}

    def pieces_of(word: str) -> tuple[str, ...]:
        own = known.get(word)
        if own is None:
            own = tuple(names.setdefault(piece, piece) for piece in _pieces(word))
            if len(known) < 200_000:
                known[word] = own
        return own

    def held(texts) -> dict[str, int]:
        counts: dict[str, int] = {}
        for text in texts:
            own: set[str] = set()
            for word in text:
                own.update(pieces_of(word))
            for piece in own:
                counts[piece] = counts.get(piece, 0) + 1
        return counts

    toxic, clean = held(bags), held(negative)
    n1, n0 = n_positive, len(negative)

    def telling(piece: str) -> float:
        k1, k0 = toxic.get(piece, 0), clean.get(piece, 0)
        p = (k1 + k0 + 1) / (n1 + n0 + 2)
        return (k1 / n1 - k0 / n0) / (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5

    strength: dict[str, float] = {}
    for word in {w for b in bags for w in b}:
        strength[word] = max(map(telling, _pieces(word)))
    return [max(b, key=lambda w: (strength[w], w)) for b in bags]


def fit(positive: list[set[str]], negative: list[set[str]], shared: dict[str, int], seed: int = 7) -> ToxicityModel:
    """Fit on bags of words. ``shared`` counts, per word, the clean training texts that hold it."""
    draw = np.random.default_rng(seed)
    letters: dict[str, int] = {}
    for bag in positive:
        for word in bag:
            for c in f"^{word}$":
                letters[c] = letters.get(c, 0) + 1
    kernel = StringKernel({c: i for i, c in enumerate(sorted(letters, key=lambda c: (-letters[c], c)))})
    # A toxic text's suspects: words that no clean text holds, or (labels err) far fewer of them.
    count: dict[str, int] = {}
    for bag in positive:
        for word in bag:
            count[word] = count.get(word, 0) + 1
    innocent = {w for w, k in shared.items() if k * len(positive) * LIFT > count.get(w, 0) * len(negative)}
    bags = [sorted({p for w in bag if w not in innocent for p in windows(w)}) for bag in positive]
    bags = [b for b in bags if b]
    if not bags or not negative:
        rate = (len(positive) + 1) / (len(positive) + len(negative) + 2)
        return ToxicityModel(kernel, TripleWeights(np.zeros(0), np.zeros(0), kernel.none), 0.0, np.array([*[0.0] * (WORST + 1), np.log(rate / (1 - rate))]))

    ranked = sorted(innocent, key=lambda w: (-shared[w], w))
    rest = ranked[FREQUENT:]
    picked = draw.choice(len(rest), size=min(DRAWN, len(rest)), replace=False) if rest else []
    clean = [p for w in ranked[:FREQUENT] + [rest[i] for i in sorted(picked)] for p in windows(w)]
    all_clean = sorted({p for w in ranked for p in windows(w)})
    clean = sorted(set(clean))
    held = set(clean)
    suspects = sorted({w for b in bags for w in b})
    # Words that a fair share of the toxic texts holds stay positive whoever is the witness.
    certain = {p: k for w, k in count.items() if w not in innocent and k >= max(3, FAIR * len(positive)) for p in windows(w)}
    witness = first_witnesses(bags, negative, len(positive))

    # Landmarks: the first witnesses, the most frequent ones first, and words of both sides by draw.
    often: dict[str, int] = {}
    for w in witness:
        often[w] = often.get(w, 0) + 1
    for w, k in certain.items():
        often[w] = often.get(w, 0) + k
    top = sorted(often, key=lambda w: (-often[w], w))[: LANDMARKS // 2]
    some, more = ([words[i] for i in draw.choice(len(words), size=min(LANDMARKS // 4, len(words)), replace=False)] for words in (clean, suspects))
    landmarks = sorted({w for w in top + some + more if len(w) >= 3}) or ["xxx"]
    values, vectors = np.linalg.eigh(kernel.gram(landmarks, landmarks))
    keep = values > 1e-4
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel.features(landmarks)
    x_clean = kernel.gram(clean, landmarks) @ whiten

    # Multiple instances: train on the worst words, find each text's worst word again, until they stay.
    model = None
    for _ in range(5):
        times = dict(certain)
        for w in witness:
            times[w] = times.get(w, 0) + 1
        chosen = sorted(times)
        x = np.vstack([kernel.gram(chosen, landmarks) @ whiten, x_clean])
        y = np.concatenate([np.ones(len(chosen)), -np.ones(len(clean))])
        weight = np.concatenate([[times[w] ** 0.5 for w in chosen], np.ones(len(clean))])
        w, intercept = train_machine(x, y, weight)
        scaled = [scale * value for (_, value), scale in zip(features, whiten @ w)]
        folded = TripleWeights(np.concatenate([triple for triple, _ in features]), np.concatenate(scaled), kernel.none)
        model = ToxicityModel(kernel, folded, intercept, np.zeros(WORST + 2))
        margin = dict(zip(suspects, model.pieces_margins(suspects).tolist()))
        renewed = [max(b, key=lambda t: (margin[t], t)) for b in bags]
        # Clean words that come near the margin join the training words, the nearest first.
        near = model.pieces_margins(all_clean)
        hard = [all_clean[i] for i in np.argsort(-near, kind="stable")[:HARD] if near[i] > -1 and all_clean[i] not in held]
        if renewed == witness and not hard:
            break
        witness = renewed
        if hard:
            held |= set(hard)
            clean += hard
            x_clean = np.vstack([x_clean, kernel.gram(hard, landmarks) @ whiten])

    words = sorted({w for bag in positive + negative for w in bag})
    margin_of = dict(zip(words, model.margins(words).tolist()))
    evidence = np.array([evidence_of([margin_of[w] for w in bag]) for bag in positive + negative])
    model.curve = calibrate(evidence, np.concatenate([np.ones(len(positive)), np.zeros(len(negative))]))
    return model


def calibrate(evidence: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over the evidence (smoothed targets, a little ridge)."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(evidence.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(evidence @ w, -60, 60)))
        gradient = evidence.T @ (p - target) + 0.01 * w
        hessian = (evidence * (p * (1 - p))[:, None]).T @ evidence + 0.01 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [sorted(units(t)) if t else [] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(bags, pa.list_(pa.string()))], names=["toxic", "words"])


def train(docs: DataFrame, labels: DataFrame, train_texts: int = TRAIN_TEXTS) -> ToxicityModel:
    """Train on up to ``train_texts`` labelled texts of each class, never of the held-out third.

    Rows with a null id or label teach nothing; an id labelled both ways counts as toxic. The
    sample is drawn in hash order of the ids and is all that reaches the driver, as bags of
    words.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    chosen = hash_draw(known.where("toxic in (0, 1)"), ["doc_id"], train_texts, "toxic")
    bags = (
        docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
        .mapInArrow(_bags, "toxic int, words array<string>").toArrow()
    )
    toxic = bags.column("toxic").to_numpy()
    names: dict[str, str] = {}  # every word once, whatever the number of its texts
    words = [{names.setdefault(w, w) for w in bag.as_py()} for bag in bags.column("words")]
    positive = [w for w, t in zip(words, toxic) if t == 1]
    negative = [w for w, t in zip(words, toxic) if t == 0]
    shared: dict[str, int] = {}
    for bag in negative:
        for word in bag:
            shared[word] = shared.get(word, 0) + 1
    return fit(positive, negative, shared)


def with_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """``docs`` with the probability that a text is toxic, from the whole text and nothing else.

    Null and empty texts and texts without letters score as texts without a toxic word.
    Repeated rows score alike; a score at the threshold counts as toxic. A column of the same
    name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[str, float] = {}
        for batch in batches:
            texts = batch.column("text")
            evidence = np.empty((batch.num_rows, WORST + 2))
            for low in range(0, batch.num_rows, 256):
                bags = [units(t) if t else set() for t in texts.slice(low, 256).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                unseen = sorted({w for bag in bags for w in bag if w not in known})
                known.update(zip(unseen, model.margins(unseen).tolist()))
                for i, bag in enumerate(bags):
                    evidence[low + i] = evidence_of([known[w] for w in bag])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.probability(evidence))], names=[*batch.schema.names, column]
            )

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(column, DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with the columns they came with."""
    name = fresh(docs, "toxicity")
    scored = with_toxicity(docs, train(docs, labels), name)
    return scored.where(F.col(name) < threshold).select(docs.columns)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return with_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
