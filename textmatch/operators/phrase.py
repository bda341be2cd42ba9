"""Phrases: exact, fuzzy and loose occurrences of several words in a text, and queries with quoted parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import levenshtein
from ..functions.text import parse_phrases
from .index import Index, dealt, union
from .search import as_queries, matches, ranked


#: Phrases that are sent to the executors at once; a call with more takes them in blocks.
BLOCK = 4096


def phrase_score(text: Column, phrase: Column, max_edit: int = 1, max_span: int | None = None, transpositions: bool = False) -> Column:
    """Struct of score and type. exact 1: the phrase occurs. fuzzy 0.7 to 0.9: words in a row, each within max_edit. proximity 0.5 to 0.7: all
    words within max_span places. Else 0 and none. transpositions: a swap of neighbours in a word counts once."""
    t, p = F.lower(text), F.lower(phrase)
    words, wanted = (F.filter(F.split(x, r"\s+"), lambda w: w != "") for x in (t, p))
    n = F.size(wanted)
    distance = (lambda a, b: _swap_distance(a, b, max_edit)) if transpositions else (lambda a, b: levenshtein(a, b, max_edit))
    sums = lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda k: distance(F.get(words, i + k), F.get(wanted, k)))
    windows = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: sums(i)))
    near = F.filter(windows, lambda d: F.forall(d, lambda x: x <= max_edit))
    spent = F.aggregate(F.get(near, F.lit(0)), F.lit(0), lambda a, x: a + x)
    fuzzy = 0.7 + 0.2 * (1 - spent / (n * max(1, max_edit)))
    places = F.transform(wanted, lambda w: F.array_position(words, w).cast("int"))
    span = F.array_max(places) - F.array_min(places)
    reach = F.lit(max_span) if max_span is not None else n * 3
    loose = F.when(F.forall(places, lambda x: x > 0) & (span <= reach), 0.5 + 0.2 * (1 - span / reach))
    found = F.struct(F.lit(0.0).alias("score"), F.lit("none").alias("type"))
    make = lambda s, k: F.struct(s.cast("double").alias("score"), F.lit(k).alias("type"))
    return F.when(F.contains(t, p), make(F.lit(1.0), "exact")).when(F.size(F.coalesce(near, F.array().cast("array<array<int>>"))) > 0, make(fuzzy, "fuzzy")).when(loose.isNotNull(), make(loose, "proximity")).otherwise(found)


def _swap_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of short words where one swap of neighbours counts once."""
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(b) - 1, F.lit(1))), lambda k: F.concat(F.substring(b, F.lit(1), k - 1), F.substring(b, k + 1, F.lit(1)), F.substring(b, k, F.lit(1)), F.substring(b, k + 2, F.length(b))) == a)
    return F.least(levenshtein(a, b, most), F.when(swapped, F.lit(1)).otherwise(F.lit(most + 1)))


def phrase_search(index: Index, queries, **options) -> DataFrame:
    """search for queries with quoted parts. Phrases meet every base word once, in blocks of BLOCK; what also matches the terms comes first, terms alone are
    worth 0.8. The scores of phrases are 1.5 times their match, 1 at most (strict: not bounded, and 1.2 times with terms, bounded)."""
    spark, strict = index.base.sparkSession, options.get("strict", False)
    asked = as_queries(spark, queries)
    texts = asked.collect()  # the queries of one call
    parsed = [(r["query_id"], *parse_phrases(r["query"])) for r in texts]
    phrases = [(q, p) for q, ps, _ in parsed for p in ps]
    terms = [(q, " ".join(ts)) for q, _, ts in parsed if ts]
    threshold = options.get("threshold") or index.config["fuzzy_threshold"]
    plain = {k: v for k, v in options.items() if k not in ("limit", "filters", "sort", "highlight")}
    out = []
    for at in range(0, len(phrases), BLOCK):
        small = spark.createDataFrame(phrases[at : at + BLOCK], "query_id long, phrase string")
        pairs = index.base.join(F.broadcast(small), F.lit(True))  # a stated set of phrases against all rows
        swap = "transpositions" in index.config["features"]
        got = pairs.withColumn("p", phrase_score(F.col("word"), F.col("phrase"), 1, None, swap)).where("p.score > 0")
        best = got.groupBy("query_id", "base_id").agg(F.max("p.score").alias("s"))
        out.append(best.select("query_id", "base_id", (F.col("s") * 1.5).alias("phrase"), F.lit(None).cast("double").alias("term")))
    if terms:
        found = matches(index, spark.createDataFrame(terms, "query_id long, query string"), **plain)
        out.append(found.select("query_id", "base_id", F.lit(None).cast("double").alias("phrase"), F.col("score").alias("term")))
    if not out:
        return ranked(matches(index, asked.where("false"), **plain))
    both = union(out).groupBy("query_id", "base_id").agg(F.max("phrase").alias("phrase"), F.max("term").alias("term"))
    has_both = F.col("phrase").isNotNull() & F.col("term").isNotNull()
    phrase = F.col("phrase") if strict else F.least(F.lit(1.0), F.col("phrase"))
    value = F.when(has_both, F.least(F.lit(1.0), phrase * 1.2)).when(F.col("phrase").isNotNull(), phrase).otherwise(F.col("term") * 0.8)
    rows = both.withColumn("score", value).where(F.col("score") >= threshold).join(dealt(index.base), "base_id").join(asked, "query_id")
    kind = F.when(has_both, "phrase_term").when(F.col("phrase").isNotNull(), "phrase").otherwise("term")
    rows = rows.select("query_id", "query", "base_id", F.col("word").alias("display"), F.col("word").alias("base_word"), F.lit(False).alias("is_synonym"), "score", F.lit(None).cast("string").alias("language"), kind.alias("match_type"),
                       F.lit(None).cast("int").alias("edit_distance"), F.lit(None).cast("string").alias("field"), "fields")
    return ranked(rows, options.get("limit") or index.config["max_results"], options.get("filters"), options.get("sort"))
