"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector w over hashed text for all grades and ordered thresholds. x holds the distinct
lower-cased words of a text, the beginnings of its words (so that a stem counts in all its forms) and the shares of their shapes, hashed into 2 ** BITS places;
places that say nothing about the grades of the rated documents (chi-square) have no weight. The model is fitted on a bounded sample, the TRAIN_ROWS rated documents with the smallest seeded hash of doc_id; every
document is scored from its whole text. Weights are a fixed 2 ** BITS floats, whatever the corpus.

Nulls: a null text is empty and is scored by the thresholds alone; null ratings and ratings of unknown documents are not used; several ratings of a document count
as their lowest. With no ratings at all every document gets grade 0 and is not kept. Rows that repeat are scored alike; rated rows that repeat are fitted as often as
they are there. No rows give no rows. A long text takes memory in proportion to its distinct words. Of equal hashes the smaller doc_id is drawn first. Columns that are not read don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, read
from .words import LONGEST, Keys, firsts, packed, raw, segments, words_in

BITS = 18
TRAIN_ROWS = 16_000
STEPS, PENALTY = 200, 3e-2
#: A place that fewer rated documents have, or whose chi-square with the grades is less, keeps the weight 0.
LEAST_DOCS, LEAST_CHI = 10, 30.0
#: Values of a word that is there, and of a shape that all words have.
PRESENT, SHAPED = 0.5, 4.0
SEED = 5
#: A document is selected if the probability of the highest grade is at least this.
KEEP = 0.5
#: Letters of a word's beginning, which words of one stem share; words that a table of words holds; bytes of text that are scored at a time.
BEGINNING = 4
MEMO_WORDS, SEGMENT = 1 << 19, 1 << 21
_SHAPE = str.maketrans({**{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "0" for c in "0123456789"}})
_RUNS = re.compile(r"(.)\1+")
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_STRIP = b".,;:!?\"'()#*$%&|<>"


def _place(named: bytes) -> int:
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(named, SEED) & ((1 << BITS) - 1)


@lru_cache(4096)
def _shape_place(form: str) -> int:
    """form: a word with letters and digits by their kind."""
    shape = _RUNS.sub(r"\1", form)
    shape = "".join(c if c in "Aa0" or not c.isalpha() else "a" for c in shape)
    return _place(b"s" + shape.encode("utf-8", "surrogatepass"))


def places_of(word: bytes) -> tuple[int, int, int]:
    """Of the word without case and outer punctuation, of its first letters, and of its shape (runs of one kind as one)."""
    body = word.strip(_STRIP)
    if word.isascii() and body.isalpha():  # most words
        plain = body.lower()
        kind = b"a" if body.islower() else b"Aa" if body[1:].islower() else b"A" if body.isupper() else body.decode().translate(_SHAPE).encode()
        return _place(b"w" + plain), _place(b"b" + plain[:BEGINNING]), _shape_place(word.replace(body, kind, 1).decode())
    plain = body.decode("utf-8", "surrogatepass").lower()
    named = (b"w" + plain.encode("utf-8", "surrogatepass"), b"b" + plain[:BEGINNING].encode("utf-8", "surrogatepass"))
    return _place(named[0]), _place(named[1]), _shape_place(word.decode("utf-8", "surrogatepass").translate(_SHAPE))


def _counts(text: str | None) -> Counter:
    counts = Counter((text or "").encode("utf-8", "surrogatepass").translate(_TO_SPACE).split(b" "))
    counts.pop(b"", None)
    return counts


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of x: PRESENT for each distinct word and beginning, SHAPED times the share of words for each shape."""
    counts = _counts(text)
    word, begin, shape = np.array([places_of(w) for w in counts], np.int64).reshape(-1, 3).T
    there = np.unique(np.r_[word, begin])
    shapes, back = np.unique(shape, return_inverse=True)
    n = np.bincount(back, np.fromiter(counts.values(), np.float64, len(counts)), len(shapes))
    return np.r_[there, shapes].astype(np.int32), np.r_[np.full(len(there), PRESENT), SHAPED * n / max(1.0, n.sum())].astype(np.float32)


class Ordinal:
    """weights (2 ** BITS) and ordered thresholds (grades - 1)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, steps: int = STEPS, penalty: float = PENALTY) -> Ordinal:
        """Maximum likelihood by Adam over all rows at once. Thresholds are a first one and the logarithms of the gaps."""
        n = len(rows)
        if not n:
            return cls(np.zeros(1 << BITS, np.float32), np.full(n_grades - 1, 30.0))
        owner = np.repeat(np.arange(n), [len(p) for p, _ in rows])
        place, value = np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float64)
        often = informative(place, grades[owner], grades, n_grades)
        owner, value, place = owner[often[place]], value[often[place]], place[often[place]]
        used, place = np.unique(place, return_inverse=True)
        scale = 1 / np.sqrt(np.bincount(place, value**2, len(used)) / n + 1e-3)  # steps of like size for rare and common places
        value = value * scale[place]
        share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 1e-3, 1 - 1e-3)
        first = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
        theta = np.r_[np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        for t in range(1, steps + 1):
            w, gaps = theta[: len(used)], np.exp(theta[len(used) + 1 :])
            cuts = theta[len(used)] + np.r_[0, np.cumsum(gaps)]
            latent = np.bincount(owner, value * w[place], n)
            up = np.where(grades < n_grades - 1, sigmoid(cuts[np.minimum(grades, n_grades - 2)] - latent), 1.0)
            down = np.where(grades > 0, sigmoid(cuts[np.maximum(grades - 1, 0)] - latent), 0.0)
            p = np.maximum(up - down, 1e-9)
            up_slope, down_slope = up * (1 - up) / p, down * (1 - down) / p  # of log p by the cut above and below
            g_latent = up_slope - down_slope  # of -log p by the latent score
            g_cuts = np.bincount(np.maximum(grades - 1, 0), down_slope, n_grades - 1) - np.bincount(np.minimum(grades, n_grades - 2), up_slope, n_grades - 1)
            g_gaps = np.cumsum(g_cuts[::-1])[::-1][1:] * gaps
            g = np.r_[np.bincount(place, value * g_latent[owner], len(used)) / n + penalty * w, g_cuts.sum() / n, g_gaps / n]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights = np.zeros(1 << BITS, np.float32)
        weights[used] = theta[: len(used)] * scale
        return cls(weights, theta[len(used)] + np.r_[0, np.cumsum(np.exp(theta[len(used) + 1 :]))])

    def latent(self, places: np.ndarray, values: np.ndarray) -> float:
        return float(self.weights[places] @ values) if len(places) else 0.0

    def tails(self, latent) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of one latent score or of an array of them."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - np.asarray(latent)[..., None], -40, 40)))

    def scorer(self) -> Scorer:
        return Scorer(self.weights)


class Scorer:
    """Latent scores of many texts at once, as of their vectors. Each distinct short word is looked at once; a table keeps MEMO_WORDS of them."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.words = weights.astype(np.float64), Keys(MEMO_WORDS)
        self.places, self.shapes = np.full((2, 1024), -1, np.int32), np.zeros(1024)

    def _learn(self, words: list[bytes]) -> int:
        """New entries; the first one's number. A place without a weight is -1."""
        first, n = self.words.n, len(words)
        self.words.room(n)
        if (more := len(self.words.low) - len(self.shapes)) > 0:
            self.places, self.shapes = np.c_[self.places, np.full((2, more), -1, np.int32)], np.r_[self.shapes, np.zeros(more)]
        found = np.array([places_of(w) for w in words], np.int64).reshape(n, 3).T
        self.places[:, first : first + n] = np.where(self.weights[found[:2]] != 0, found[:2], -1)
        self.shapes[first : first + n] = self.weights[found[2]]
        self.words.n += n
        return first

    def _entries(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.int32)
        short = np.flatnonzero(sizes <= LONGEST)
        low, high = packed(data, starts[short], sizes[short])
        found = self.words.find(low, high)
        order, number, one = firsts(low, high, found)
        held = data.tobytes()
        if len(one):
            at = short[one]
            first = self._learn([held[s:e] for s, e in zip(starts[at].tolist(), (starts[at] + sizes[at]).tolist(), strict=True)])
            self.words.name(first, low[one], high[one])
            found[order] = first + number
        out[short] = found
        long = np.flatnonzero(sizes > LONGEST)
        texts = [held[s:e] for s, e in zip(starts[long].tolist(), (starts[long] + sizes[long]).tolist(), strict=True)]
        place = {w: k for k, w in enumerate(dict.fromkeys(texts))}
        first = self.named = self.words.n
        self._learn(list(place))  # without keys: forgotten after the segment
        out[long] = [first + place[w] for w in texts]
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        shaped, total, pairs = np.zeros(n), np.zeros(n), [np.zeros(0, np.int64)]
        for data, bounds, owner in segments(*raw(texts.fill_null("")), SEGMENT):
            if self.words.n > MEMO_WORDS:
                self.words.clear()
            starts, sizes = words_in(data, bounds)
            own = owner[np.searchsorted(bounds, starts, "right") - 1]
            entries = self._entries(data, starts, sizes)
            total += np.bincount(own, minlength=n)
            shaped += np.bincount(own, self.shapes[entries], n)
            for place in self.places[:, entries]:
                hit = place >= 0
                pairs.append(np.unique(own[hit] << BITS | place[hit]))
            self.words.n = self.named
        there = np.unique(np.concatenate(pairs))
        return PRESENT * np.bincount(there >> BITS, self.weights[there & (1 << BITS) - 1], n) + SHAPED * shaped / np.maximum(total, 1)


def informative(place: np.ndarray, grade: np.ndarray, grades: np.ndarray, n_grades: int) -> np.ndarray:
    """For each place whether at least LEAST_DOCS rated documents have it and their grades differ from the others' by a chi-square of LEAST_CHI."""
    count = np.bincount(grade * (1 << BITS) + place, minlength=n_grades << BITS).reshape(n_grades, -1)
    total = count.sum(axis=0)
    expected = np.bincount(grades, minlength=n_grades)[:, None] / len(grades) * total
    chi = ((count - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0)
    return (total >= min(LEAST_DOCS, len(grades))) & (chi >= LEAST_CHI)


def train(docs: DataFrame, ratings: DataFrame, train_rows: int = TRAIN_ROWS) -> Ordinal:
    """ratings: doc_id, grade (0, 1, 2, ...)."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    drawn = rated.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(train_rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most train_rows pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [vector(t.as_py()) for t in b.column(0)]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)), b.column(1), b.column(2)], ["places", "vals", "grade", "doc_id"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    got = arrow_map(picked.select("text", "grade", "doc_id"), run, f"places array<int>, vals array<float>, grade int, doc_id {kind}").toArrow().sort_by("doc_id")
    rows = [(np.array(p.values.to_numpy(), np.int32), v.values.to_numpy()) for p, v in zip(got.column("places"), got.column("vals"), strict=True)]
    grades = got.column("grade").to_numpy().astype(np.int64)
    return Ordinal.fit(rows, grades, max(2, int(grades.max(initial=0)) + 1))


def graded(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """doc_id, expected_grade, p_top (probability of the highest grade), kept for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 2 ** BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*held.value)
        score = own.scorer()
        for b in batches:
            tails = own.tails(score(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep)], ["doc_id", "expected_grade", "p_top", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, expected_grade double, p_top double, kept boolean")


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from the two labels: 0 for poor text, 1 for good but toxic text, 2 for good text."""
    toxic = F.coalesce("toxic", F.lit(0)) > 0
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") <= 0, 0).when(toxic, 1).otherwise(2).alias("grade"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return graded(docs, train(docs, ratings_of(read(spark, sf_dir, "labels"))))
