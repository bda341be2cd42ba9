"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are given out in blocks of BLOCK words. The blocks of the whole mix go to the sources by the highest quotients target / (2k + 1);
the blocks of a source go to its shards (by hash of the document, some hundred documents each, so that a source of any size is split)
by the highest quotients size / (2k + 1). A shard's documents lie one after another in a seeded order; its quota takes whole
passes over them and then the first blocks of that order. So every document but one a shard is taken whole, reruns agree, and
none is taken more than LIMIT times.

The driver holds one row a source. Quotas of shards are found where the shards are: by the divisor method, which gives the seats of
the highest quotients; a few passes over the table of shards narrow the divisor, and the seats still open go by rank, which a sort by ranges finds.

Nulls: a null text has size 0; null is a source of its own, the last. A null doc_id is an id like any other. Rows that repeat doc_id, source and
size are counted, numbered and dealt out like different documents, so none gather in a shard. Shards with equal quotients are taken by their number.
Empty input gives an empty mix. A text of any length is one document, of which a quota may take the beginning. Columns that are not read don't matter; those that begin with __tm_ are taken.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words_of, read, scratch, table

WEIGHTS = (1.0, 2.0, 3.0)
LIMIT = 3
BLOCK = 64
DOCS_PER_SHARD = 256
SEED = 2024


def targets(sizes: list[int], weights: list[float], limit: float = LIMIT) -> list[float]:
    """Shares of sum(sizes) by weight; what is above limit times a size is shared anew among the others."""
    out, open_, left = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(limit * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients weight / (2k + 1); the earlier of equal ones first."""
    total = sum(weights)
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    got = [math.floor(w * seats / total + 0.5) for w in weights]
    while (n := sum(got)) > seats:  # take back the lowest quotients
        worst = heapq.nsmallest(n - seats, ((w / (2 * g - 1), -i) for i, (w, g) in enumerate(zip(weights, got, strict=True)) if g))
        for _, i in worst:
            got[-i] -= 1
    heap = [(-w / (2 * g + 1), i) for i, (w, g) in enumerate(zip(weights, got, strict=True)) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    # the rounding above can leave a seat where a higher quotient waits; trade until none does
    while True:
        low = min((weights[i] / (2 * g - 1), -i) for i, g in enumerate(got) if g)
        high = max((weights[i] / (2 * g + 1), -i) for i, g in enumerate(got))
        if high[0] <= low[0]:
            return got
        got[-low[1]] -= 1
        got[-high[1]] += 1


def _quotas(shards: DataFrame, plan: DataFrame, fan: int = 32, passes: int = 3) -> DataFrame:
    """no, shard, words, seats: the seats of each source (plan: no, words, shards, largest, seats) over its shards.

    With divisor d a shard gets floor(words / d + 1/2) seats; f(d), their sum, falls as d grows. lo and hi keep f(lo) >= seats >= f(hi)."""
    n, q, w = F.col("shards"), F.col("seats"), F.col("words").cast("double")
    bracket = plan.where("seats > 0 and words > 0").select("no", "seats", (w / (q + n)).alias("lo"), F.when(2 * q > n, w / (q - n / 2)).otherwise(F.col("largest") * 2.001).alias("hi"))
    rows = {r["no"]: r.asDict() for r in bracket.collect()}
    spark = shards.sparkSession
    for _ in range(passes):
        if not rows:
            break
        tried = [(k, j, r["lo"] * (r["hi"] / r["lo"]) ** (j / fan)) for k, r in rows.items() for j in range(1, fan)]
        at = spark.createDataFrame(tried, "no int, j int, d double")
        sums = shards.join(at, "no").groupBy("no", "j").agg(F.min("d").alias("d"), F.sum(F.floor(F.col("words") / F.col("d") + 0.5)).alias("f"))
        for x in sums.collect():  # fan rows a source
            r = rows[x["no"]]
            if x["f"] >= r["seats"]:
                r["lo"] = max(r["lo"], x["d"])
            else:
                r["hi"] = min(r["hi"], x["d"])
    known = spark.createDataFrame([(k, r["seats"], r["lo"], r["hi"]) for k, r in rows.items()], "no int, all_seats long, lo double, hi double")
    placed = shards.join(known, "no").select("no", "shard", "words", "all_seats", F.floor(F.col("words") / F.col("hi") + 0.5).alias("sure"), F.floor(F.col("words") / F.col("lo") + 0.5).alias("most"))
    placed = table(placed, "quotas")
    left = placed.groupBy("no").agg((F.first("all_seats") - F.sum("sure")).alias("left"))
    rank = ranked(placed.where("most > sure"), "no", F.col("words") / (2 * F.col("sure") + 1), "shard")
    more = rank.join(left, "no").where("rank <= left").select("no", "shard", F.lit(1).alias("one"))
    return placed.join(more, ["no", "shard"], "left").select("no", "shard", "words", (F.col("sure") + F.coalesce("one", F.lit(0))).alias("seats"))


def ranked(df: DataFrame, of: str, value: Column, tie: str) -> DataFrame:
    """df with rank: its place among the rows of the same value of the column of, by falling value, then by tie. A sort by ranges, so that a group of any
    size lies in many partitions; the offsets are a row a partition and group."""
    ranges = df.withColumn("__tm_value", value).repartitionByRange(of, F.desc("__tm_value"), tie).withColumn("__tm_part", F.spark_partition_id())
    ranges = table(ranges, "ranges")
    before = Window.partitionBy(of).orderBy("__tm_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy(of, "__tm_part").count().withColumn("__tm_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy(of, "__tm_part").orderBy(F.desc("__tm_value"), tie))
    placed = ranges.withColumn("__tm_inside", inside).join(offsets, [of, "__tm_part"])
    return placed.withColumn("rank", F.col("__tm_before") + F.col("__tm_inside")).select(*df.columns, "rank")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK, docs_per_shard: int = DOCS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs. weights repeat over the sources in code point order."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        sized = docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"))
        counted = table(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
        found = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs")).collect()  # a row a source
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        words, share = [r["words"] for r in found], [weights[i % len(weights)] for i in range(len(found))]
        aims = targets(words, share, limit)
        seats = sainte_lague(aims, round(sum(words) / block))
        kind = counted.schema["source"].dataType.simpleString()
        plan = [(i, r["source"], r["words"], aims[i], seats[i], math.ceil(r["docs"] / docs_per_shard)) for i, r in enumerate(found)]
        sources = spark.createDataFrame(plan, f"no int, source {kind}, source_size long, target double, seats long, shards int")
        each_row = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))  # rows that repeat are dealt out like others
        key = lambda salt: F.xxhash64(F.lit(salt), "doc_id", "size", "copy")
        dealt = each_row.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        cols = ["doc_id", F.col("d.source").alias("source"), "size", "copy", "no", "source_size", "target"]
        dealt = keep(table(dealt.select(*cols, F.pmod(key(seed), "shards").cast("int").alias("shard"), key(seed + 1).alias("place")), "dealt"))
        shards = table(dealt.groupBy("no", "shard").agg(F.sum("size").alias("words")), "shards")
        each = shards.groupBy("no").agg(F.sum("words").alias("words"), F.count("*").alias("shards"), F.max("words").alias("largest"))
        quotas = keep(table(_quotas(shards, each.join(sources.select("no", "seats"), "no")), "shard-quotas"))

    in_order = Window.partitionBy("no", "shard").orderBy("place", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("before", F.sum("size").over(in_order) - F.col("size"))
    q = quotas.select("no", "shard", F.col("words").alias("shard_words"), F.least(F.col("seats") * block, F.col("words") * limit).alias("quota"))
    got = placed.join(q, ["no", "shard"], "left")
    full = F.coalesce(F.expr("quota div nullif(shard_words, 0)"), F.lit(0))
    rest = F.coalesce(F.expr("quota % nullif(shard_words, 0)"), F.lit(0))
    taken = full * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", rest - F.col("before")))
    return got.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken whole, and one with its first words
    where a quota ends inside it (n_chars, if there is one, follows the text). Rows that repeat doc_id, source and size share what
    they were given evenly."""
    cols = docs.columns
    got = mix(docs, **parameters).groupBy("doc_id", "source", "size").agg(F.floor(F.avg("taken")).alias("taken")).where("taken > 0")
    got = table(got.select(*[F.col(c).alias(f"__tm_{c}") for c in got.columns]), "taken")
    sized = docs.withColumn("__tm_n", n_words_of(F.col("text")))
    on = F.col("doc_id").eqNullSafe(F.col("__tm_doc_id")) & F.col("source").eqNullSafe(F.col("__tm_source")) & (F.col("__tm_n") == F.col("__tm_size"))
    whole, part = F.expr("__tm_taken div __tm_size").cast("int"), (F.col("__tm_taken") % F.col("__tm_size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = sized.join(got, on).withColumn("__tm_part", F.explode(copies))
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("__tm_part") > 0, F.array_join(F.slice(pieces, F.lit(1), F.col("__tm_part")), "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", cut)
    if "n_chars" in cols:
        rows = rows.withColumn("n_chars", F.when(F.col("__tm_part") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*cols)


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """Sizes and targets of op5_source_mixing, which SQL can express; targets to four places."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k FROM s),
c AS (SELECT *, sum(3 * source_size) OVER (ORDER BY k) - 3 * source_size AS before, sum(w) OVER (ORDER BY k DESC) AS rest, sum(source_size) OVER () AS total FROM r),
l AS (SELECT *, (total - before)::DOUBLE / rest::DOUBLE AS level FROM c),
f AS (SELECT k AS first, level FROM l WHERE level * w <= 3 * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, round(CASE WHEN k < (SELECT first FROM f) THEN 3.0 * source_size ELSE (SELECT level FROM f) * w END, 4)::DOUBLE AS target FROM l)
SELECT doc_id, size, source_size, target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
