"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of the perfect [63, 57] Hamming code on the low 63 bits of a fingerprint: every 63-bit word lies
within the covering radius 1 of an anchor. A pair that differs in 2 bits or fewer has a word halfway, at most 1 bit from
either, and the anchor nearest to that word is within 1 + 1 bits of both. So the threshold of 2 is shared by the two sides: each
fingerprint goes to every anchor within 2 bits (1 or 32 of them), and no linked pair is missed. An anchor's bucket can't grow
with the corpus: it holds 2 * (1 + 63 + 1953) distinct fingerprints at most. Equal fingerprints are one class before they are
replicated, so thousands of exact copies cost one row.

Each bucket gives a spanning forest of its links, not its pairs; label propagation with pointer jumping over those few edges, which move
along with the labels, gives the components. Every table that an iteration reads lies in the shared folder.

one_of_similar (the stage of the pipeline) links texts whose sets of five-word shingles have a similarity of SIMILAR or more. Its candidates are the pairs
whose SimHashes of these shingles differ in REACH bits or fewer: of the two halves of 31 bits one differs in 2 or fewer, and the codewords of the perfect
[31, 26] Hamming code are the anchors of a half (1 or 16 within 2 bits), so no pair in reach is missed. At a similarity of 0.8 two SimHashes differ in
about 10 bits, and a covering code that reaches so far has millions of anchors a fingerprint, so what is out of reach has an exact way of its own beside it:
bands of minimal hashes; a pair of exactly 0.8 shares none of the BANDS with probability 7e-6 (less above). Forests of anchors and stars of bands give groups
of candidates, and a group is compared in units of bounded size, where
all texts meet by their shared shingles, so each link is checked exactly and none between members of a group is missed.

Nulls: a null text has no words (fingerprint zero), like an empty one. A null doc_id is a document of its class like any other; component_id is the
smallest doc_id that is not null, null only if the component has no other. Repeated rows are kept by near_duplicates, with equal results. No rows
give no rows. A text of any length is hashed CHUNK shingles at a time. Other columns pass through whatever their names; those that begin with
__tm_ are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import LOWER, UPPER, arrow_map, drop, read, scratch, table

SHINGLE = 3
THRESHOLD = 2
SEED = 42
#: Of one_of_similar: words of a shingle, least similarity, bands and minimal hashes of a band.
WIDE, SIMILAR = 5, 0.8
BANDS, ROWS = 30, 5
#: Differing bits of SimHashes up to which one_of_similar has all pairs as candidates, and bits of each half.
REACH, HALF = 5, 31
#: Shingles of a unit of one_of_similar (of one text, if it has more), and sets with most candidates (one of each of so many shares) that every block of a group meets.
BLOCK, PIVOTS = 1 << 20, 8
#: Hashes whose bits are added at a time; bounds the memory for one very long text.
CHUNK = 1 << 16
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text, CHUNK at a time."""
    from xxhash import xxh64_intdigest

    # ASCII bytes never occur inside a UTF-8 sequence, so bytes can be lower-cased and split without decoding
    words = [w for w in (text or "").encode().translate(_LOWER).translate(_BLANKS).split(b" ") if w]
    size = min(size, len(words))
    n = len(words) - size + 1 if words else 0
    for at in range(0, n, CHUNK):
        part = [words[at + k : min(n, at + CHUNK) + k] for k in range(size)]
        yield np.fromiter((xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*part, strict=True))), np.uint64, len(part[0]))


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text: bit b is 1 if set in over half of the shingle hashes."""
    return _majority(_shingle_hashes(text, size))


def _majority(parts: Iterable[np.ndarray]) -> int:
    """Unsigned 64-bit number whose bits are set in over half of the hashes."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in parts:
        n += len(hashes)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in range(64) if 2 * int(ones[b]) > n))


def fingerprints(docs: DataFrame, size: int = SHINGLE, *also: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns of also, which are of type long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint_of(t.as_py(), size) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got), *b.columns[2:]], ["doc_id", "fp", *also])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text", *also), run, ", ".join([f"doc_id {kind}", "fp long", *(f"{c} long" for c in also)]))


def syndrome(fp: Column, bits: int = 63) -> Column:
    """XOR of the positions 1 to bits of the low bits (63 or another power of 2 less 1) that are set: 0 for an anchor, else the position to flip to reach one."""
    got = F.lit(0)
    for k in range(bits.bit_length()):
        mask = sum(1 << (p - 1) for p in range(1, bits + 1) if p >> k & 1)
        got = got + F.shiftleft((F.bit_count(fp.bitwiseAND(F.lit(mask))) % 2).cast("int"), k)
    return got


def anchors(fp: Column, bits: int = 63) -> Column:
    """Array of all anchors within 2 bits of the low bits (see syndrome) of fp."""
    low, one = fp.bitwiseAND(F.lit((1 << bits) - 1)), F.lit(1).cast("long")
    bit = lambda p: F.call_function("shiftleft", one, p - 1)

    def near(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.lit(bits)), lambda i: (i < i.bitwiseXOR(s)))
        pairs = F.transform(firsts, lambda i: low.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(s))))
        return F.when(s == 0, F.array(low)).otherwise(F.concat(F.array(low.bitwiseXOR(bit(s))), pairs))

    return F.element_at(F.transform(F.array(syndrome(fp, bits)), near), 1)


def _forest(fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between distinct fingerprints of one bucket."""
    edges, u = [], fps.view(np.uint64)
    rest = np.arange(len(fps))
    while len(rest):  # one component at a time, breadth first, each member against those not yet reached
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = np.bitwise_count(u[rest] ^ u[x]) <= threshold
            near, rest = rest[hit], rest[~hit]
            queue += near.tolist()
            edges += [(int(fps[x]), int(fps[y])) for y in near]
    return edges


def link_edges(classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a, b: edges whose components are those of all links between the distinct fp of classes."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("these anchors cover thresholds up to 2")
    return _bucket_edges(classes.select("fp", F.explode(anchors(F.col("fp"))).alias("anchor")), threshold)


def wide_edges(classes: DataFrame, reach: int = REACH) -> DataFrame:
    """As link_edges for up to REACH differing bits, by the anchors of both halves. Bits 62 and 63 count in distances only."""
    if not 0 <= reach <= REACH:
        raise ValueError("the anchors of two halves cover distances up to 5")
    low = anchors(F.col("fp"), HALF)
    high = F.transform(anchors(F.shiftright("fp", HALF), HALF), lambda a: a + (1 << HALF))
    return _bucket_edges(classes.select("fp", F.explode(F.concat(low, high)).alias("anchor")), reach)


def _bucket_edges(placed: DataFrame, threshold: int) -> DataFrame:
    """a, b: forests of the links in each bucket of placed (fp, anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; a bucket may go on in the next batch."""

        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

        def links(anchor: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            ends = np.r_[starts[1:], len(anchor)]
            return [e for s, t in zip(starts, ends, strict=True) if t - s > 1 for e in _forest(fp[s:t], threshold)]

        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in batches:
            if not b.num_rows:
                continue
            fp, anchor = (np.r_[h, b.column(k).to_numpy()] for h, k in zip(held, (0, 1), strict=True))
            cut = int(np.searchsorted(anchor, anchor[-1]))
            held = (fp[cut:], anchor[cut:])
            if cut and (edges := links(anchor[:cut], fp[:cut])):
                yield out(sorted(set(edges)))
        if len(held[0]) and (edges := links(held[1], held[0])):
            yield out(sorted(set(edges)))

    return arrow_map(placed.repartition("anchor").sortWithinPartitions("anchor"), run, "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _lowest(edges: DataFrame) -> DataFrame:
    """node, label: where each node of edges comes to by going on to the smallest node around it, until none around is smaller. Label of label doubles the way each time."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    low = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        up = low.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jump = low.join(up, "label")
        if jump.where("label <> higher").isEmpty():
            return low
        jumped = table(jump.select("node", F.col("higher").alias("label")), "labels")
        drop(low)
        low = jumped


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of the component of each node that has an edge. In each round labels fall to the lowest node down the way (see _lowest), and edges
    move to the labels of their ends. What comes together is dropped or one edge, so only the first round joins all edges, each end once, and a dense group costs
    later rounds no more than a sparse one. Two rounds at least halve the nodes that still have edges: a lowest node either has taken all around it or meets a lower one next."""
    of = lambda low, end: low.select(F.col("node").alias(end), F.col("label").alias("to"))
    with scratch(edges.sparkSession) as keep:
        rest, labels = table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges"), None
        while True:
            low = _lowest(rest)
            # greater ends first: a node in the middle of a star is the smaller end, and its edges are few by the second join
            half = rest.join(of(low, "b"), "b").select("a", F.col("to").alias("b")).where("a <> b").distinct()
            moved = half.join(of(low, "a"), "a").select(F.least("to", "b").alias("a"), F.greatest("to", "b").alias("b")).where("a <> b").distinct()
            left = table(moved, "edges")
            drop(rest)
            rest = left
            if labels is None:
                labels = keep(low)
            else:
                fallen = keep(table(labels.join(of(low, "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels"))
                drop(labels, low)
                labels = fallen
            if rest.isEmpty():
                return labels


def shingle_set(text: str | None, size: int = WIDE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    parts = list(_shingle_hashes(text, size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _set_key(hashes: np.ndarray) -> int:
    """Signed long that names a set of hashes, 0 for the empty set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def _bands(hashes: np.ndarray) -> list[int]:
    """A long for each band of minimal hashes; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    rng = np.random.default_rng(SEED)
    factor, shift = rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    factor = factor * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * factor + shift).min(axis=0), out=least)
    found = np.array([xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    return found.view(np.int64).tolist()


def signatures(docs: DataFrame, size: int = WIDE, *also: str) -> DataFrame:
    """doc_id, key (hash of the text), fp (names the shingle set), n (its size), sim (its SimHash), bands, and the columns of also, which are of type long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, sims, bands = [], [], [], []
            for t in b.column(2):
                own = shingle_set(t.as_py(), size)
                keys.append(_set_key(own))
                sizes.append(len(own))
                sims.append(_majority(own[at : at + CHUNK] for at in range(0, len(own), CHUNK)))
                bands.append(_bands(own))
            made = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(sims, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made, *b.columns[3:]], ["doc_id", "key", "fp", "n", "sim", "bands", *also])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", "key long", "fp long", "n long", "sim long", "bands array<long>", *(f"{c} long" for c in also)])
    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("key"), "text", *also), run, schema)


def _similar_forest(names: list[int], sets: list[np.ndarray], labels: list[int], similarity: float) -> list[tuple[int, int]]:
    """Edges that join the sets of one unit as their links do; sets of one label are joined already. Sets meet by the shingles they share only."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    own = [codes[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    of = np.unique(labels, return_inverse=True)[1]
    mates = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
    todo, edges, live = np.ones(len(sets), bool), [], 0

    def postings() -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), sizes)
        held = np.flatnonzero(todo[owner])
        held = held[np.argsort(codes[held], kind="stable")]
        return owner[held], np.searchsorted(codes[held], np.arange(codes.max() + 2))

    def reached(k: int) -> list[int]:
        mine = mates[of[k]]
        todo[mine] = False
        return mine.tolist()

    while todo.any():
        queue = reached(int(np.argmax(todo)))
        while queue and (left := int(todo.sum())):
            if not live or left * 2 < live:  # those already reached are no longer met
                (owner, first), live = postings(), left
            x = queue.pop()
            lo, n = first[own[x]], first[own[x] + 1] - first[own[x]]
            met = owner[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            shared = np.bincount(met, minlength=len(sets))
            for y in np.flatnonzero(todo & (shared >= similarity * (sizes + sizes[x] - shared) - 1e-9)).tolist():
                edges.append((names[x], names[y]))
                if todo[y]:
                    queue += reached(y)
    return edges


def _unit_edges(units: DataFrame, size: int, similarity: float) -> DataFrame:
    """a, b for units: unit, fp, label, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; only the hashes of the unit at hand are held."""

        def out() -> pa.RecordBatch:
            edges = _similar_forest(names, sets, labels, similarity)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

        last, names, labels, sets = None, [], [], []
        for b in batches:
            for unit, fp, label, text in zip(*(b.column(k) for k in range(4)), strict=True):
                if (unit := unit.as_py()) != last:
                    if len(names) > 1:
                        yield out()
                    last, names, labels, sets = unit, [], [], []
                names.append(fp.as_py())
                labels.append(label.as_py())
                sets.append(shingle_set(text.as_py(), size))
        if len(names) > 1:
            yield out()

    return arrow_map(units.select("unit", "fp", "label", "text").repartition("unit").sortWithinPartitions("unit"), run, "a long, b long")


def simhash_edges(signed: DataFrame, reach: int = REACH) -> DataFrame:
    """a, b: edges whose components are those of all pairs of shingle sets whose SimHashes differ in reach bits or fewer. Sets of one SimHash are a class."""
    prints = table(signed.where("n > 0").select("fp", "sim").distinct(), "simhashes")
    firsts = table(prints.groupBy("sim").agg(F.min("fp").alias("first")), "simhash-classes")
    same = prints.join(firsts, "sim").where("first <> fp").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    found = table(wide_edges(firsts.select(F.col("sim").alias("fp")), reach), "simhash-edges")
    of = lambda side: firsts.select(F.col("sim").alias(side), F.col("first").alias(f"first_{side}"))
    return same.unionByName(found.join(of("a"), "a").join(of("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))


def similar_edges(docs: DataFrame, signed: DataFrame, size: int = WIDE, similarity: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """a, b: edges whose components are those of all links between the distinct shingle sets of docs. signed: see signatures.

    A group of candidates is compared in units of about block shingles. First each block of a group is, with the group's PIVOTS sets that have
    most candidates: what is close to the middle of a group becomes one component there. Groups of several blocks are then blocked
    anew, large components by themselves, and each two blocks but those of one component are a unit."""
    placed = table(signed.groupBy("fp").agg(F.first("bands").alias("bands")).select("fp", F.explode("bands").alias("band")), "bands")
    firsts = placed.groupBy("band").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    met = placed.join(firsts, "band")
    stars = table(met.groupBy("a", F.col("fp").alias("b")).agg(F.sum("n").alias("met")), "stars")
    groups = components(simhash_edges(signed).unionByName(stars.where("a <> b").select("a", "b")))
    degree = stars.groupBy(F.col("b").alias("fp")).agg(F.sum("met").alias("degree"))
    chosen = signed.groupBy("fp").agg(F.min("key").alias("key"), F.max("n").alias("n"))
    grouped = chosen.join(groups.select(F.col("node").alias("fp"), F.col("label").alias("group")), "fp").join(degree, "fp", "left")
    grouped = table(grouped.select("group", "fp", "key", "n", F.coalesce("degree", F.lit(0)).alias("degree")), "grouped")
    whole = grouped.groupBy("group").agg(F.sum("n").alias("total")).withColumn("blocks", F.ceil(F.col("total") / block).cast("int"))
    distinct = docs.select(F.xxhash64("text").alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    texts = table(distinct.join(grouped.select("key", "fp"), "key").select("fp", "text"), "texts")
    near = grouped.join(whole, "group")
    seed = F.xxhash64(F.lit(SEED), "fp")
    own = near.select("fp", F.xxhash64("group", F.pmod(seed, "blocks")).alias("unit"))
    large = near.where("blocks > 1")
    pivots = large.groupBy("group", "blocks", F.pmod(seed, F.lit(PIVOTS)).alias("of")).agg(F.max(F.struct("degree", "fp")).alias("p"))
    spread = pivots.select(F.col("p.fp").alias("fp"), "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    units = own.unionByName(spread.select("fp", F.xxhash64("group", F.col("k").cast("long")).alias("unit"))).distinct()
    one = table(_unit_edges(units.join(texts, "fp").withColumn("label", F.col("fp")), size, similarity), "unit-edges")
    held = table(large.drop("degree"), "large-groups")
    if held.isEmpty():
        return one
    named = held.join(components(one).select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = table(named.select("group", "fp", "n", "label"), "named")
    by_label = named.groupBy("group", "label").agg(F.sum("n").alias("weight"))
    blocked = named.join(by_label, ["group", "label"]).withColumn("own", F.when(F.col("weight") * 2 >= block, F.col("label")))
    of_mixed = blocked.groupBy("group", "own").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
    blocked = blocked.alias("x").join(of_mixed.alias("y"), (F.col("x.group") == F.col("y.group")) & F.col("x.own").eqNullSafe(F.col("y.own")))
    blocked = table(blocked.select("x.group", "x.fp", "x.label", "x.own", F.pmod(seed, "parts").cast("int").alias("part")), "blocked")
    blocks = table(blocked.groupBy("group", "own", "part").agg(F.xxhash64("group", "own", "part").alias("id")), "blocks")  # a row a block, not a text
    one_side, other = blocks.select("group", F.col("own").alias("own_a"), F.col("id").alias("id_a")), blocks.select("group", F.col("own").alias("own_b"), F.col("id").alias("id_b"))
    pairs = one_side.join(other, "group").where("id_a <= id_b AND NOT (own_a IS NOT NULL AND own_a <=> own_b)")
    pairs = table(pairs.select(F.xxhash64("id_a", "id_b").alias("unit"), F.array_distinct(F.array("id_a", "id_b")).alias("ids")).select("unit", F.explode("ids").alias("id")), "block-pairs")
    again = blocked.withColumn("id", F.xxhash64("group", "own", "part")).select("fp", "label", "id").join(pairs, "id").join(texts, "fp")
    return one.unionByName(_unit_edges(again, size, similarity))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    with scratch(docs.sparkSession) as keep:
        prints = keep(table(fingerprints(docs, size), "fingerprints"))
        rooted = _rooted(prints, lambda: link_edges(prints.select("fp").distinct(), threshold))
        roots = rooted.join(prints, "fp").groupBy("root").agg(F.min("doc_id").alias("component_id"))
        of_class = keep(table(rooted.join(roots, "root").select("fp", "component_id"), "components"))
    return prints.join(of_class, "fp").select("doc_id", "fp", "component_id")


def _rooted(prints: DataFrame, edges_of: Callable[[], DataFrame]) -> DataFrame:
    """fp, root: each distinct fp of prints and what names its component."""
    labels = components(edges_of())
    fps = prints.select("fp").distinct()
    return table(fps.join(labels, fps.fp == labels.node, "left").select("fp", F.coalesce("label", "fp").alias("root")), "rooted")


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id; rows without one come last, and of rows
    that share a doc_id, the one with the smallest hash of its values. Of rows that repeat in all values one stays."""
    return _one_of_each(docs, lambda d: fingerprints(d, size, "__tm_row", "__tm_key"), lambda prints: link_edges(prints.select("fp").distinct(), threshold))


def one_of_similar(docs: DataFrame, size: int = WIDE, similarity: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """As one_of_each, but texts are linked whose shingle sets have a Jaccard similarity of at least this."""
    return _one_of_each(docs, lambda d: signatures(d, size, "__tm_row", "__tm_key"), lambda signed: similar_edges(docs, signed, size, similarity, block))


def _one_of_each(docs: DataFrame, prints_of: Callable[[DataFrame], DataFrame], edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    cols = docs.columns
    hashed = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    marked = docs.withColumn("__tm_row", F.xxhash64(*hashed)).withColumn("__tm_key", F.xxhash64(F.lit(SEED), "doc_id", "text"))
    with scratch(docs.sparkSession) as keep:
        prints = table(prints_of(marked), "prints")
        rooted = _rooted(prints, lambda: edges_of(prints))
        order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__tm_row", "__tm_key")
        best = prints.join(rooted, "fp").groupBy("root").agg(F.min(order).alias("best")).select("best.__tm_row", "best.__tm_key")
        kept = keep(table(best, "kept"))
    return marked.dropDuplicates(["__tm_row", "__tm_key"]).join(kept.hint("merge"), ["__tm_row", "__tm_key"], "left_semi").select(*cols)


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
