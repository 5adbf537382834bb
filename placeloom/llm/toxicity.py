"""Toxicity by a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel of two words sums, over all common subsequences of three characters, ``decay`` to the
power of the spans they take in both words; it is normalised to 1 for equal words.  Characters put
into a word or left out of it cost a factor each, so disguised insults stay near their models.

Landmarks are words of labelled toxic sentences whose document frequencies tell the classes apart.
A text is a bag of words; its pooled kernel values with the landmarks (the strongest, their
number, their density) go through the Nyström map K_LL^(-1/2) and a linear squared-hinge SVM,
whose margin a logistic curve turns into a score.

Fitting runs on the driver on at most ``sample_rows`` labelled documents (a bound that does not
grow with the data); scoring covers every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import batches_of

#: At the ends of words these carry nothing.
EDGES = ".,;:!?\"'()[]{}|#$%&*<>«»¡¿-_/\\=+~`^"
LONG = 28
#: Shapes of the pooled values: the strongest value is raised, the counted ones are lowered towards clear matches.
STRONGEST, COUNTED = 0.7, 2
#: Single characters that follow each other with white space between are read as one word too.
SPELT = re.compile(r"(?<=\s)\S(?:\s\S){2,}(?=\s)")
MAYBE_SPELT = re.compile(r"\s\S\s\S\s\S\s")
SENTENCE = re.compile(r"[.!?]+\s|\n")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without edge punctuation; spelt-out words are added joined."""
    low = f" {(text or '').lower()} "
    out = [w.strip(EDGES) for w in low.split()]
    # symbols put between the letters of a word are taken out as well
    out += ["".join(filter(str.isalnum, w)) for w in out if w and not w.isalnum()]
    if MAYBE_SPELT.search(low):
        out += ["".join(filter(str.isalnum, m[0])) for m in SPELT.finditer(low)]
    return out


def pieces(word: str) -> list[str]:
    """A word of ordinary length as it is; a longer one as overlapping windows that cover it."""
    return [word] if len(word) <= LONG else [word[k : k + LONG] for k in range(0, len(word) - LONG // 2, LONG // 2)]


def kernel(pairs: list[tuple[str, str]], decay: float = 0.75, length: int = 3) -> np.ndarray:
    """The unnormalised subsequence kernel of each pair of strings, by dynamic programming over all pairs at once."""
    if not pairs:
        return np.zeros(0, np.float32)
    n, m = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    s = np.zeros((n, len(pairs)), np.int32)
    t = np.zeros((m, len(pairs)), np.int32)
    for k, (a, b) in enumerate(pairs):
        s[: len(a), k] = [ord(c) for c in a]
        t[: len(b), k] = [ord(c) for c in b]
    t[t == 0] = -1  # padding never matches
    # held[i][b]: weight of common subsequences of length i within s[:a] and t[:b], spans counted to the ends
    held = [np.ones((m + 1, len(pairs)), np.float32)] + [np.zeros((m + 1, len(pairs)), np.float32) for _ in range(length - 1)]
    total = np.zeros(len(pairs), np.float32)
    square = np.float32(decay * decay)
    lam = np.float32(decay)
    for a in range(n):
        same = (t == s[a]) & (s[a] > 0)
        rows = np.flatnonzero(same.any(axis=1))
        for b in rows:
            total += np.where(same[b], square * held[length - 1][b], 0)
        for i in range(length - 1, 0, -1):
            now = held[i]
            now *= lam
            run = np.zeros(len(pairs), np.float32)
            for b in range(rows[0] if len(rows) else m, m):
                run *= lam
                if same[b].any():
                    run += np.where(same[b], square * held[i - 1][b], 0)
                now[b + 1] += run
    return total


def skips(word: str) -> set[str]:
    """Pairs of characters with at most two others between them."""
    return {*map(str.__add__, word, word[1:]), *map(str.__add__, word, word[2:]), *map(str.__add__, word, word[3:])}


class Landmarks:
    """Normalised kernel values of words with the landmarks.

    A pair with fewer common skips than ``share`` of the landmark's, or a value under ``floor``,
    counts as 0: few words meet any landmark, and only those run through the dynamic program.
    Values are kept for words seen before, in bounded memory.
    """

    def __init__(self, names: list[str], decay: float = 0.75, floor: float = 0.25, share: float = 0.4, limit: int = 300_000):
        self.names, self.decay, self.floor, self.limit = names, decay, floor, limit
        # a word's skips are counted for all landmarks at once, in lanes of one whole number
        self.index: dict[str, int] = {}
        need = 0
        for k, name in enumerate(names):
            own = skips(name)
            for x in own:
                self.index[x] = self.index.get(x, 0) + (1 << (16 * k))
            need += (0x8000 - max(2, int(np.ceil(share * len(own))))) << (16 * k)
        self.need, self.lanes = need, sum(0x8000 << (16 * k) for k in range(len(names)))
        self.own = kernel([(n, n) for n in names], decay)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def values(self, words: Iterable[str]) -> dict[str, tuple]:
        """word -> ((landmark, value), ...) for words that meet any."""
        out: dict[str, tuple] = {}
        todo: list[str] = []
        for w in set(words):
            x = self.young.get(w)
            if x is None and (x := self.old.get(w)) is not None:
                self.young[w] = x
            if x is None:
                todo.append(w)
            elif x:
                out[w] = x
        pairs, at = [], []
        get = self.index.get
        for w in todo:
            for p in pieces(w):
                total = 0
                for x in skips(p):
                    if n := get(x):
                        total += n
                enough = (total + self.need) & self.lanes if total else 0
                while enough:
                    low = enough & -enough
                    k = low.bit_length() // 16 - 1
                    enough ^= low
                    pairs.append((p, self.names[k]))
                    at.append((w, k))
        found: dict[str, dict[int, float]] = {}
        order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][0]))  # like lengths together
        for lo in range(0, len(order), 4096):
            part = order[lo : lo + 4096]
            some = [pairs[k] for k in part]
            unique = list({a for a, _ in some})
            self_of = dict(zip(unique, kernel([(a, a) for a in unique], self.decay)))
            for k, v in zip(part, kernel(some, self.decay)):
                w, mark = at[k]
                norm = float(v) / max(1e-12, float(self_of[pairs[k][0]]) * float(self.own[mark])) ** 0.5
                if norm >= self.floor:
                    best = found.setdefault(w, {})
                    best[mark] = max(best.get(mark, 0.0), norm)
        for w in todo:
            x = tuple(found[w].items()) if w in found else ()
            if len(w) <= 64:
                self.young[w] = x
            if x:
                out[w] = x
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return out

    def pooled(self, texts: list[list[str]]) -> np.ndarray:
        """For each bag of words three blocks of as many features as landmarks: strongest value, number, density."""
        m = len(self.names)
        known = self.values(w for t in texts for w in t)
        out = np.zeros((len(texts), 3 * m), np.float32)
        for row, bag in zip(out, texts):
            top, count = row[:m], row[m : 2 * m]
            for w in filter(known.__contains__, bag):
                for k, v in known[w]:
                    if v > top[k]:
                        top[k] = v
                    count[k] += v**COUNTED
            row[2 * m :] = 30.0 * count / (30.0 + len(bag))
            np.log1p(count, out=count)
            top **= STRONGEST
        return out


@dataclass
class Model:
    """A fitted scorer, small enough to travel with each task."""

    landmarks: list[str]
    decay: float
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scorer(self) -> Landmarks:
        return Landmarks(self.landmarks, self.decay)

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        margin = pooled @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def choose_landmarks(bags: list[set[str]], labels: np.ndarray, most: int, decay: float) -> list[str]:
    """The words of toxic documents that tell the classes apart best, near repeats left out."""
    toxic, clean = Counter(), Counter()
    for bag, y in zip(bags, labels):
        (toxic if y else clean).update(bag)
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))

    def worth(w: str) -> float:
        p, q = toxic[w] / n1, clean[w] / n0
        pool = (toxic[w] + clean[w] + 1) / (n1 + n0)
        return (p - q) / (pool * (1 / n1 + 1 / n0)) ** 0.5

    ranked = sorted((w for w in toxic if 3 <= len(w) <= LONG and toxic[w] >= 3), key=lambda w: (-worth(w), w))[: 12 * most]
    chosen: list[str] = []
    own: dict[str, float] = {}
    for w in ranked:
        if worth(w) < 3 or len(chosen) == most:
            break
        own[w] = float(kernel([(w, w)], decay)[0])
        near = kernel([(w, c) for c in chosen], decay)
        if all(v / (own[w] * own[c]) ** 0.5 < 0.85 for v, c in zip(near, chosen)):
            chosen.append(w)
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, cost: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by accelerated gradient descent; classes weigh alike."""
    sign = np.where(y > 0, 1.0, -1.0)
    c = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())) * cost
    full = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = v = np.zeros(full.shape[1])
    # the largest curvature bounds the step
    u = np.random.Generator(np.random.PCG64(1)).standard_normal(full.shape[1])
    for _ in range(30):
        u = full.T @ (c * (full @ u))
        top = np.linalg.norm(u)
        u /= max(top, 1e-12)
    step = 1 / (2 * top + 1)
    for k in range(rounds):
        slack = np.maximum(0, 1 - sign * (full @ v))
        grad = v - 2 * full.T @ (c * slack * sign)
        grad[-1] -= v[-1]  # the bias is free
        new = v - step * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def fit(texts: list[str | None], labels: Iterable[int], landmarks: int = 64, decay: float = 0.75, cost: float = 300.0) -> Model:
    """Fits on labelled texts, whose sentences are pooled by text.  Without both classes the score is the rate of toxic labels."""
    y = np.array(list(labels), dtype=np.float64)
    rate = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 0.01, 0.99))
    flat = Model([], decay, np.zeros(0), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    if not 0 < y.sum() < len(y):
        return flat
    bags = [[w for s in SENTENCE.split(t or "") for w in words_of(s)] for t in texts]
    names = choose_landmarks([set(b) for b in bags], y, landmarks, decay)
    if not names:
        return flat
    marks = Landmarks(names, decay)
    pooled = np.concatenate([marks.pooled(bags[k : k + 500]) for k in range(0, len(bags), 500)]).astype(np.float64)
    m = len(names)
    gram = kernel([(a, b) for a in names for b in names], decay).reshape(m, m).astype(np.float64)
    d = np.sqrt(np.diag(gram))
    values, vectors = np.linalg.eigh(gram / d[:, None] / d[None, :])
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.1))) @ vectors.T
    nystroem = np.kron(np.eye(3), root)
    x = pooled @ nystroem
    # margins of documents not fitted on give the logistic curve
    fold = np.arange(len(y)) % 4
    margin = np.zeros(len(y))
    for f in range(4):
        if 0 < y[fold != f].sum() < (fold != f).sum():
            w, b = _svm(x[fold != f], y[fold != f], cost)
            margin[fold == f] = x[fold == f] @ w + b
    slope, shift = 1.0, 0.0
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    goal = np.where(y > 0, hi, lo)
    for _ in range(100):  # Newton steps of Platt's fit
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = np.array([((p - goal) * margin).sum() + 1e-3 * slope, (p - goal).sum()])
        h = p * (1 - p) + 1e-9
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, g)
        slope, shift = slope - np.clip(move[0], -2, 2), shift - np.clip(move[1], -2, 2)
    w, b = _svm(x, y, cost)
    return Model(names, decay, nystroem @ w, b, float(max(slope, 0.0)), float(shift))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text is divisible by five; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 5000, **options: float) -> Model:
    """Fits on the labelled documents outside the held-out fifth, at most ``sample_rows`` of them, picked by a hash of the id."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    once = docs.select("doc_id", "text").join(some, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = once.orderBy("doc_id").collect()  # at most sample_rows
    return fit([r.text for r in rows], [int(r.toxic > 0) for r in rows], **options)


_scorers: dict[tuple, Landmarks] = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for each row of ``docs``, from the whole text only.

    Null and empty texts meet no landmark and get the score of such a text.  Repeated rows are
    scored alike.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tuple(model.landmarks), model.decay)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = model.scorer()
        marks = _scorers[key]
        for b in batches:
            parts = []
            for lo in range(0, b.num_rows, 1000):
                bags = [words_of(t) for t in b.column(1).slice(lo, 1000).to_pylist()]
                parts.append(model.scores(marks.pooled(bags)) if model.landmarks else model.scores(np.zeros((len(bags), 0))))
            if parts:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.concatenate(parts).astype(np.float64))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    return batches_of(rows).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
