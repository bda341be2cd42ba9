"""Line dedup by winnowing, in DataFrame operations only.

A line is what lies between line feeds; lines without a word never begin or end a run and go with the run around them. A run of
lines of MIN_WORDS words or more that occurred before (at a smaller doc_id, or further up in the document) is deleted wherever it occurs
again.

1. Winnowing: a gram is the shortest run of lines from a line on with GRAM_WORDS words; of the grams inside the shortest run of MIN_WORDS words
   from a line, the one with the smallest hash is the fingerprint. Every run of MIN_WORDS words thus holds a fingerprint.
2. Fingerprints that occur at one position only drop their runs: nothing around them can repeat.
3. Around the others, matches are extended both ways: the shortest runs of MIN_WORDS words that begin, and those that end, at each line.
   Equal runs (by hash of their lines) are one group with its first position; the later ones are deleted. A longer match is the union of such
   runs, so its ends are exact, and a group of any size costs a row an occurrence, never a pair.

Keys are hashes, groups are counted and ordered by partial aggregates, and the joins on hot keys read written tables, so that
adaptive execution can split them. Joins are merge joins at every size: a side that would fit a broadcast today grows with the corpus. Long runs are 64-bit hashes of their lines' 64-bit hashes.

A repeated passage that begins and ends inside lines is not whole lines, and stays: the unit of this method is the line.

Nulls: a null text stays null and has no lines. Rows that repeat a doc_id with the same text are one document. Null doc_ids come first. Of equal runs the first by doc_id,
hash of the text and place stays. No rows give no rows. A long text is one row, and costs the square of the ranges to delete in it at worst. Other columns pass through
whatever their names; those that begin with __tm_ are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read, scratch, table, words_of

MIN_WORDS = 50
GRAM_WORDS = 25


def _needed(counts: Column, i: Column, words: int) -> Column:
    """Number of lines from the i-th on that hold that many words; null if they run out. Each line has a word."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"))
    step = lambda a, x: F.when(a["n"] >= words, a).otherwise(F.struct((a["n"] + x).alias("n"), (a["k"] + 1).alias("k")))
    return F.aggregate(F.slice(counts, i + 1, F.lit(words)), start, step, lambda a: F.when(a["n"] >= words, a["k"]))


def _all_needed(counts: Column, words: int) -> Column:
    return F.transform(counts, lambda _, i: _needed(counts, i, words))


def _run(hashes: Column, first: Column, n: Column) -> Column:
    return F.xxhash64(F.slice(hashes, first + 1, n))


def _windows(nb: Column, min_words: int, gram_words: int) -> Column:
    """Array of s, e (first and last line of a run), g and p (hash and position of its fingerprint), h (hash of the run)."""

    def made(v: Column) -> Column:  # v: hs, ns, ahead and grams (lines needed from each line on), back (up to each line)
        hs, ahead, back, grams = v["hs"], v["ahead"], v["back"], v["grams"]
        gram = F.transform(grams, lambda k, j: F.struct(F.when(k.isNotNull(), _run(hs, j, k)).alias("g"), j.alias("p"), (j + k).alias("end")))

        def with_grams(gram: Column) -> Column:
            finger = F.transform(ahead, lambda k, a: F.when(k.isNotNull(), F.array_min(F.filter(F.slice(gram, a + 1, k), lambda g: g["end"] <= a + k))))

            def with_fingers(finger: Column) -> Column:
                window = lambda s, n: F.struct(s.alias("s"), (s + n - 1).alias("e"), F.get(finger, s)["g"].alias("g"), F.get(finger, s)["p"].alias("p"), _run(hs, s, n).alias("h"))
                down = F.filter(F.transform(ahead, lambda k, a: F.when(k.isNotNull(), window(a, k))), lambda x: x.isNotNull())
                up = F.filter(F.transform(back, lambda k, b: F.when(k.isNotNull() & (F.get(ahead, b - k + 1) < k), window(b - k + 1, k))), lambda x: x.isNotNull())
                return F.concat(down, up)

            return let(finger, with_fingers)

        return let(gram, with_grams)

    def split(v: Column) -> Column:
        reverse = let(F.reverse(v["ns"]), lambda r: F.reverse(_all_needed(r, min_words)))
        return let(F.struct(v["hs"].alias("hs"), _all_needed(v["ns"], min_words).alias("ahead"), reverse.alias("back"), _all_needed(v["ns"], gram_words).alias("grams")), made)

    return let(F.struct(F.transform(nb, lambda x: x["h"]).alias("hs"), F.transform(nb, lambda x: x["n"]).alias("ns")), split)


def _merged(ranges: Column) -> Column:
    """Sorted ranges (s, e) with overlapping and touching ones joined."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        joined = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(a) > 0) & (x["s"] <= last["e"] + 1), joined).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(ranges, empty, step)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """doc_id, key (hash of the text), cut: the lines to delete as sorted ranges (s, e) of line numbers from 0; only documents with some."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.size(words_of(x)).alias("n")))
    held = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("key"), F.filter(lines, lambda x: x["n"] > 0).alias("nb"))
    held = table(held, "lines")
    found = held.select("doc_id", "key", F.explode(_windows(F.col("nb"), min_words, gram_words)).alias("w")).select("doc_id", "key", "w.*")
    found = table(found, "windows")
    at = F.struct("doc_id", "key", "p")
    again = table(found.groupBy("g").agg(F.min(at).alias("a"), F.max(at).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("g"), "fingerprints")
    near = table(found.join(again.hint("merge"), "g", "left_semi").select("doc_id", "key", "s", "e", "h"), "candidates")
    place = F.struct("doc_id", "key", "s")
    first = table(near.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("h", "first"), "first-runs")
    later = near.join(first.hint("merge"), "h").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "key", "s", "e")
    ranges = later.groupBy("doc_id", "key").agg(_merged(F.sort_array(F.collect_set(F.struct("s", "e")))).alias("r"))
    ranges = table(ranges.select("doc_id", "key", "r"), "ranges")
    mine = held.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.transform("nb", lambda x: x["i"]).alias("i")).dropDuplicates(["d", "k"])
    named = mine.join(ranges.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    return named.select("doc_id", "key", F.transform("r", lambda x: F.struct(F.get("i", x["s"]).alias("s"), F.get("i", x["e"]).alias("e"))).alias("cut"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """docs with text as it is without repeated runs, and __tm_lines and __tm_removed (numbers of lines)."""
    with scratch(docs.sparkSession) as keep:
        cuts = repeated_runs(docs, min_words, gram_words).select(F.col("doc_id").alias("__tm_id"), F.col("key").alias("__tm_key"), F.col("cut").alias("__tm_cut"))
        cuts = keep(table(cuts, "cuts"))
    same = F.col("doc_id").eqNullSafe(F.col("__tm_id")) & (F.xxhash64("text") == F.col("__tm_key"))
    joined = docs.join(cuts.hint("merge"), same, "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.exists("__tm_cut", lambda r: (r["s"] <= i) & (i <= r["e"])))
    gone = F.aggregate("__tm_cut", F.lit(0), lambda a, r: a + r["e"] - r["s"] + 1)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    out = joined.withColumn("__tm_lines", n).withColumn("__tm_removed", F.coalesce(gone, F.lit(0)).cast("long"))
    out = out.withColumn("text", F.when(F.col("__tm_cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.select(*docs.columns, "__tm_lines", "__tm_removed")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    got = deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("__tm_lines").alias("n_lines"), F.col("__tm_removed").alias("n_removed"), "text")


OP3_SQL = r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS no, ls[i] AS x, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k, sum(n) OVER (PARTITION BY doc_id ORDER BY no) AS p FROM l WHERE n > 0),
j AS (SELECT a.doc_id, a.k AS s, z.k AS e FROM b a JOIN b z ON a.doc_id = z.doc_id AND z.k BETWEEN a.k AND a.k + 49 AND z.p - a.p + a.n >= 50),
w AS (SELECT doc_id, s, min(e) AS e FROM j GROUP BY ALL UNION SELECT doc_id, max(s) AS s, e FROM j GROUP BY doc_id, e),
r AS (SELECT w.doc_id, s, e, min(no) AS lo, max(no) AS hi, string_agg(x, chr(10) ORDER BY k) AS run FROM w JOIN b ON w.doc_id = b.doc_id AND b.k BETWEEN s AND e GROUP BY w.doc_id, s, e),
c AS (SELECT doc_id, lo, hi FROM (SELECT *, rank() OVER (PARTITION BY run ORDER BY doc_id, s) AS place FROM r) WHERE place > 1),
k AS (SELECT l.doc_id, no, x, EXISTS (SELECT 1 FROM c WHERE c.doc_id = l.doc_id AND no BETWEEN lo AND hi) AS gone FROM l)
SELECT t.doc_id, count(no)::BIGINT AS n_lines, count(no) FILTER (WHERE gone)::BIGINT AS n_removed,
  CASE WHEN any_value(text) IS NOT NULL THEN coalesce(string_agg(x, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') END AS text
FROM t LEFT JOIN k USING (doc_id) GROUP BY t.doc_id
"""
