"""Benchmark decontamination by latent semantic retrieval.

1. Words of every text become numbers of the benchmark's vocabulary (0: a word that no item has), once, in the shared folder.
2. Terms are weighted by their document frequency over the whole corpus (those in many documents not at all). Passages of PASSAGE words, of documents and items, are the rows
   of a TF-IDF matrix A. Its randomised SVD takes one pass: each task adds up Z = A'(AW) and G = (AW)'(AW) for a random W; with G = R'R,
   Z inv(R) = A'Q for the orthonormal Q of AW, and its singular vectors span the latent space.
3. Each document's overlapping windows meet the items by cosine in that space; a window at COSINE or more is a candidate. Beside that, exactly:
   a stretch that shares as many word pairs with an item as must stay when words of it are replaced down to PARAPHRASE (for short items, none) is one too,
   so neither the rank nor the number of items can lose a copy that is verbatim or has replaced words.
4. A candidate is checked by the longest common subsequence of the item and the words around the window: LCS of the item's words is a
   leak; from PARAPHRASE on it is one if the item's answer (what follows "answer:", else its last sentence) is there too.

What is broadcast is bounded by the benchmark, whose words (those of the vocabulary itself) are counted first; above BLOCK_WORDS the items are
taken in blocks, each against all documents; one item alone may be longer. Broadcasts and tables of a block go when its leaks are written. Sums over
passages are added in two levels, so no task gets more than a share of the partial sums.

Nulls: a document or item whose text is null or holds no word has no leak. Rows that repeat a document are flagged alike; an item text that repeats
is reported for each item_id. Without documents or items there are no leaks. Of stretches with the same share of an item the one with the greatest
cosine counts. A long document is searched 4,096 windows at a time, in memory of some 400 bytes for each ten of its words. Columns that are not read don't matter; those that begin with __tm_ are taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, read, scratch, table

PASSAGE, STEP = 40, 10
RANK, EXTRA = 88, 8
COSINE = 0.55
#: Terms in more than this share of the documents have no weight, but each window of an item keeps the rarer half of its terms, RARE at
#: least: an item that has leaked into many documents must not become common by that.
COMMON, RARE = 0.02, 6
LCS, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: Items of fewer words than this must be there word for word.
SHORT = 8
BLOCK_WORDS = 200_000
#: Words of documents that are searched together.
SEARCH_WORDS = 1 << 15
SEED = 17
BATCH_ROWS = 512
SPLIT = r"[^\p{L}\p{N}]+"
_WORDS = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)")


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _words(text: str) -> Column:
    """As words(), for a column."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def answer(text: str) -> list[str]:
    """Words of what follows the last "answer:", else of the last sentence that has three words, else of all."""
    _, mark, rest = text.lower().rpartition("answer:")
    if mark and words(rest):
        return words(rest)
    return next((w for s in reversed(_SENTENCE.split(text)) if len(w := words(s)) >= 3), words(text))


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a word of a to a bit."""
    at: dict[int, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if hit := at.get(y, 0):
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Items:
    """A block of benchmark items: vocabulary, words as numbers, answers, windows."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        texts = [words(r[1]) for r in rows]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.codes = [np.array([self.vocabulary[w] for w in t], np.int32) for t in texts]
        self.answers = [[self.vocabulary[w] for w in answer(r[1])] for r in rows]

    def windows(self) -> list[tuple[int, int, np.ndarray]]:
        """(item, chunks of STEP words that a document's window for it has, codes); long items have several."""
        out = []
        for k, c in enumerate(self.codes):
            size = PASSAGE if len(c) > PASSAGE // 2 + STEP // 2 else PASSAGE // 2
            for at in range(0, max(1, len(c) - size // 2), size):
                out.append((k, size // STEP, c[at : at + size] if len(c) - at >= size else c[max(0, len(c) - size) :]))
        return out


def coded(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Table of doc_id, key (hash of the text), codes of the words of every text."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("key"), _words("text").alias("words"))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                lists = part.column(2)
                offsets = lists.offsets.to_numpy()
                flat = lists.values[offsets[0] : offsets[-1]].dictionary_encode()
                number = np.fromiter((held.value.get(w, 0) for w in flat.dictionary.to_pylist()), np.int32, len(flat.dictionary))
                codes = number[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int32)
                got = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(codes, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), got], ["doc_id", "key", "codes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = table(arrow_map(cut, run, f"doc_id {kind}, key long, codes array<int>"), "codes")
    held.destroy()
    return out


def _sums(codes: np.ndarray, passage: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Z and G of the passages (number of the passage of each word)."""
    known = weight[codes] > 0
    codes, passage = codes[known], passage[known]
    if not len(codes):
        return np.zeros(w.shape), np.zeros((w.shape[1], w.shape[1]))
    first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])  # passages without a weighted word add nothing
    passage = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(codes)]))
    norm = np.sqrt(np.bincount(passage, weight[codes].astype(np.float64) ** 2)) + 1e-9
    value = (weight[codes] / norm[passage]).astype(np.float32)
    y = np.add.reduceat(w[codes] * value[:, None], first, axis=0)
    z = np.zeros_like(w, np.float64)
    order = np.argsort(codes, kind="stable")
    of = codes[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    z[of[first]] = np.add.reduceat(y[passage[order]] * value[order][:, None], first, axis=0)
    return z, (y.T @ y).astype(np.float64)


def term_weights(items: Items, seen: np.ndarray, n_docs: int) -> np.ndarray:
    """Squared idf, 0 for common terms."""
    weight = (np.log((n_docs + 1) / (seen + 1)).astype(np.float32) + 0.1) ** 2
    keep = seen <= max(5, COMMON * n_docs)
    for _, _, codes in items.windows():
        distinct = np.unique(codes)
        keep[distinct[np.argsort(seen[distinct], kind="stable")][: max(RARE, len(distinct) // 2)]] = True
    keep[0] = False
    return np.where(keep, weight, 0).astype(np.float32)


def latent_space(docs: DataFrame, items: Items, rank: int = RANK, seed: int = SEED) -> np.ndarray:
    """A row of the latent space for each number of the vocabulary, times the term's weight. docs: see coded."""
    spark, size, wide = docs.sparkSession, len(items.vocabulary) + 1, rank + EXTRA
    n_docs = docs.count()
    seen = np.zeros(size)
    for t, n in docs.select(F.explode(F.array_distinct("codes")).alias("t")).groupBy("t").count().collect():  # at most a row a term
        seen[t] = n
    weight = term_weights(items, seen, n_docs)
    w = np.random.default_rng(seed).standard_normal((size, wide)).astype(np.float32)
    held = spark.sparkContext.broadcast((weight, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, w = held.value
        z, g = np.zeros(w.shape), np.zeros((w.shape[1], w.shape[1]))
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                lists = b.column(0).slice(at, BATCH_ROWS)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                codes = lists.values.to_numpy()[offsets[0] : offsets[-1]]
                sizes = np.diff(offsets)
                first = np.r_[0, np.cumsum(-(-sizes // PASSAGE))]
                inside = np.arange(len(codes)) - np.repeat(offsets[:-1] - offsets[0], sizes)
                one, two = _sums(codes, np.repeat(first[:-1], sizes) + inside // PASSAGE, weight, w)
                z += one
                g += two
        parts = [g, *(z[k : k + 256] for k in range(0, len(z), 256))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in group.column("sums"))
        return group.slice(0, 1).select(["part"]).append_column("sums", pa.array([total.tobytes()], pa.binary()))

    partial = arrow_map(docs.select("codes"), run, "part int, sums binary")
    some = partial.withColumn("salt", F.pmod(F.hash(F.md5("sums")), F.lit(32))).groupBy("part", "salt").applyInArrow(add, "part int, sums binary")
    parts = dict(some.groupBy("part").applyInArrow(add, "part int, sums binary").collect())  # the size of W and of G
    held.destroy()
    z, g = np.zeros((size, wide)), np.zeros((wide, wide))
    own = items.codes
    number = np.concatenate([np.full(len(c), k) for k, c in enumerate(own)]).astype(np.int64)
    one, two = _sums(np.concatenate(own), number, weight, w)
    if parts:
        g = np.frombuffer(parts.pop(0)).reshape(g.shape).copy()
        z = np.concatenate([np.frombuffer(parts[k]).reshape(-1, wide) for k in sorted(parts)])
    z, g = z + one, g + two
    values, vectors = np.linalg.eigh(g)  # inv(R) up to a rotation, without directions that hold nothing
    good = values > 1e-9 * values.max()
    basis = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)[0][:, :rank]
    return (basis * weight[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-9)


class Search:
    """Leaks of a block of items in the words of a document."""

    def __init__(self, items: Items, space: np.ndarray):
        self.codes, self.answers, self.space = items.codes, items.answers, space
        self.of_item, self.of_text = np.zeros((2, len(space)), bool)  # marked words; none between calls
        self.weighted = np.abs(space).sum(axis=1) > 0
        self.by_size = {}
        self.base = len(space)  # a pair of words is first * base + second; an item of one word has it with 0
        pairs = [np.unique(c[:-1].astype(np.int64) * self.base + c[1:] if len(c) > 1 else c.astype(np.int64) * self.base) for c in items.codes]
        owner = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        pairs = np.concatenate(pairs)
        order = np.argsort(pairs, kind="stable")
        self.pairs, first = np.unique(pairs[order], return_index=True)
        self.pair_owner, self.pair_first = owner[order], np.r_[first, len(order)]
        self.sizes = np.array([len(c) for c in items.codes])
        kept = np.where(self.sizes < SHORT, self.sizes, np.ceil(PARAPHRASE * self.sizes - 1e-9)).astype(np.int64)
        self.need = np.maximum(1, self.sizes - 1 - 2 * (self.sizes - kept))
        self.windows = {}
        found = items.windows()
        for k, size, c in found:
            self.windows.setdefault(k, []).append((size, c))
        for size in sorted({s for _, s, _ in found}):
            mine = [(k, c) for k, s, c in found if s == size]
            self.by_size[size] = np.array([k for k, _ in mine]), _unit(np.stack([space[c].sum(axis=0) for _, c in mine])).T.copy()

    def _exact(self, padded: np.ndarray, doc_of: np.ndarray, best: dict) -> None:
        """Adds (None, chunk, chunks of a window) for items that share enough word pairs with a stretch of a document."""
        wide = padded.astype(np.int64)
        at = np.flatnonzero((padded[:-1] > 0) & (padded[1:] > 0))
        keys = wide[at] * self.base + wide[at + 1]
        if (self.sizes == 1).any():
            alone = np.flatnonzero(padded)
            keys, at = np.r_[keys, wide[alone] * self.base], np.r_[at, alone]
        place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        hit = self.pairs[place] == keys
        place, at = place[hit], at[hit]
        first = self.pair_first[place]
        n = self.pair_first[place + 1] - first
        if not n.sum():
            return
        owner = self.pair_owner[np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        group = doc_of[at // STEP] * len(self.sizes) + owner
        order = np.lexsort((at, group))
        owner, at, group = owner[order], at[order], group[order]
        last = np.arange(len(at)) + self.need[owner] - 1
        within = np.minimum(last, len(at) - 1)
        good = (last < len(at)) & (group[within] == group) & (at[within] - at <= self.sizes[owner] * 3 // 2)
        n_chunks = len(doc_of)
        for key in np.unique(owner[good] * n_chunks + at[good] // STEP).tolist():
            item, chunk = divmod(key, n_chunks)
            best.setdefault((int(doc_of[chunk]), item), []).append((None, chunk, self.windows[item][0][0]))

    def _cosine(self, item: int, codes: np.ndarray) -> float:
        """Greatest cosine of a window of the item with these words."""
        mine = _unit(self.space[codes].sum(axis=0)[None])[0]
        return max(float(_unit(self.space[c].sum(axis=0)[None])[0] @ mine) for _, c in self.windows[item])

    def leaks(self, codes: np.ndarray) -> list[tuple[int, float, float]]:
        """(item, cosine, share of the item in the longest common subsequence) of one document."""
        return [x[1:] for x in self.leaks_of(codes, np.array([0, len(codes)]))]

    def leaks_of(self, codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(document, item, cosine, share) of documents that lie one after another. Each is padded to whole chunks, to the widest window and to a gap at
        least, so that no window, pair or stretch reaches from one into the next."""
        sizes = np.diff(offsets)
        real = -(-sizes // STEP)
        held = np.maximum(real, max(self.by_size)) + 1
        start = np.cumsum(held) - held
        padded = np.zeros(int(held.sum()) * STEP, np.int32)
        padded[np.repeat(start * STEP - (offsets[:-1] - offsets[0]), sizes) + np.arange(int(sizes.sum()))] = codes[offsets[0] : offsets[-1]]
        doc_of = np.repeat(np.arange(len(sizes)), held)
        best: dict[tuple[int, int], list] = {}
        self._exact(padded, doc_of, best)
        self._latent(padded, doc_of, start, real, best)
        found: dict[int, dict[int, list]] = {}
        for (doc, item), hits in best.items():
            found.setdefault(doc, {})[item] = [(cosine, chunk - int(start[doc]), size) for cosine, chunk, size in hits]
        return [(doc, *x) for doc in sorted(found) for x in self._checked(codes[offsets[doc] : offsets[doc + 1]], found[doc])]

    def _latent(self, padded: np.ndarray, doc_of: np.ndarray, start: np.ndarray, real: np.ndarray, best: dict) -> None:
        """Adds (cosine, chunk, chunks of the window) of the windows that are like an item."""
        known = np.flatnonzero(self.weighted[padded])
        if not len(known):
            return
        n = len(doc_of)
        chunk = known // STEP
        first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        chunks, count = np.zeros((n, self.space.shape[1]), np.float32), np.bincount(chunk, minlength=n)
        chunks[chunk[first]] = np.add.reduceat(self.space[padded[known]], first, axis=0)
        local = np.arange(n) - start[doc_of]
        for size, (owner, vectors) in self.by_size.items():
            fits = local < np.maximum(1, real - size + 1)[doc_of]
            words_in = np.convolve(count, np.ones(size, np.int64))[size - 1 :]  # of the window that begins at each chunk
            busy = np.flatnonzero(fits & (words_in > 0))  # a window without weighted words is like no item
            for lo in range(0, len(busy), 4096):  # bounds the memory for one very long text
                rows = busy[lo : lo + 4096]
                cosine = _unit(sum(chunks[rows + k] for k in range(size))) @ vectors
                flat = cosine.ravel()
                for at in np.flatnonzero(flat >= COSINE).tolist():
                    i, j = divmod(at, len(owner))
                    row = int(rows[i])
                    best.setdefault((int(doc_of[row]), int(owner[j])), []).append((float(flat[at]), row, size))

    def _checked(self, codes: np.ndarray, best: dict[int, list]) -> list[tuple[int, float, float]]:
        out = []
        for item, hits in best.items():
            own, done, top = self.codes[item], -1, None
            need = 1.0 if len(own) < SHORT else LCS
            least = (1.0 if len(own) < SHORT else PARAPHRASE) * len(own)
            self.of_item[own] = True
            for cosine, i, size in sorted(hits, key=lambda h: h[1]):
                if i <= done:  # that stretch has been compared
                    continue
                lo, hi = max(0, i * STEP - len(own)), (i + size) * STEP + len(own)
                done = i + 1
                near = codes[lo:hi]
                both = self.of_item[near]
                if np.count_nonzero(both) < least:  # however its words stand, no leak
                    continue
                near = near[both]
                self.of_text[near] = True
                most = np.count_nonzero(self.of_text[own])
                self.of_text[near] = False
                if most < least:
                    continue
                near = near.tolist()
                share = lcs(own.tolist(), near) / len(own)
                asked = self.answers[item]
                if share >= need or len(own) >= SHORT and share >= PARAPHRASE and lcs(asked, near) >= ANSWER * len(asked):
                    if cosine is None:
                        cosine = self._cosine(item, codes[i * STEP : (i + size) * STEP])
                    top = max(top or (share, cosine), (share, cosine))
            self.of_item[own] = False
            if top:
                share, cosine = top
                out.append((item, cosine, share))
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, key (hash of the text), item_id, cosine, lcs: a row for each document and item that leaked into it."""
    spark = docs.sparkSession
    asked = benchmark.where("text is not null").select("item_id", "text")
    total = asked.agg(F.sum(F.size(_words("text")))).first()[0] or 0
    n_blocks = max(1, -(-total // block_words))
    out = None
    for k in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()  # about block_words words, or one longer item
        items = Items(sorted((tuple(r) for r in rows if words(r["text"])), key=lambda r: (r[0] is not None, r)))
        if items.ids:
            got = _leaks_of(docs, items, benchmark.schema["item_id"].dataType)
            out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], _found_schema(docs, benchmark.schema["item_id"].dataType)) if out is None else out


def _found_schema(docs: DataFrame, item_type) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, item_id {item_type.simpleString()}, cosine double, lcs double"


def _leaks_of(docs: DataFrame, items: Items, item_type) -> DataFrame:
    """Table of the leaks of a block of items; nothing else of the search stays."""
    spark = docs.sparkSession
    arrow_type = to_arrow_type(item_type)
    with scratch(spark) as keep:
        own = coded(docs, items.vocabulary)
        held = spark.sparkContext.broadcast((items, latent_space(own, items)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, space = held.value
            search = Search(items, space)
            for b in batches:
                lists, found = b.column(2), []
                offsets, codes = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
                k = 0
                while k < b.num_rows:  # documents of about SEARCH_WORDS words at a time
                    stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SEARCH_WORDS, "right")) - 1)
                    found += [(k + doc, *x) for doc, *x in search.leaks_of(codes, offsets[k : stop + 1])]
                    k = stop
                at = pa.array([f[0] for f in found], pa.int64())
                made = [pa.array([items.ids[f[1]] for f in found], arrow_type), *(pa.array([f[j] for f in found], pa.float64()) for j in (2, 3))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *made], ["doc_id", "key", "item_id", "cosine", "lcs"])

        out = keep(table(arrow_map(own, run, _found_schema(docs, item_type)), "leaks"))
        held.destroy()
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs into which no item leaked, with their columns."""
    bad = find_leaks(docs, benchmark).select(F.col("doc_id").alias("__tm_id"), F.col("key").alias("__tm_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__tm_id")) & (F.xxhash64("text") == F.col("__tm_key"))
    return docs.join(bad, same, "left_anti").select(*docs.columns)


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    got = find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), "lcs")
