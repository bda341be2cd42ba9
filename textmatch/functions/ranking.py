"""BM25 as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, MIN_IDF = 1.2, 0.75, 0.1


def idf(n_docs: Column, df: Column, least: float = MIN_IDF) -> Column:
    value = F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5) + 1), F.lit(least))
    return F.when((df <= 0) | (n_docs <= 0), F.lit(least)).otherwise(value)


def term_score(tf: Column, idf_: Column, length: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    return F.when(tf <= 0, 0.0).otherwise(idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))


def squashed(score: Column) -> Column:
    """A score of 0 to about 10 as 0 to 1."""
    return 1 / (1 + F.exp(-(score / 10 * 6 - 3)))


def combined(bm25: Column, fuzzy: Column, w_bm25: float = 0.6, w_fuzzy: float = 0.4) -> Column:
    return (w_bm25 * bm25 + w_fuzzy * fuzzy) / (w_bm25 + w_fuzzy)


def corpus_stats(docs: DataFrame, words: Column) -> tuple[DataFrame, DataFrame]:
    """One row of n_docs and mean_length (in words), and df of each term. words: array of the words of a row."""
    totals = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(words)).alias("mean_length"))
    return totals, docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


#: Pairs of a document and a query that a task of rank adds up, about; query words that are sent to the documents, more meet them by key.
TASK_PAIRS, SENT = 1 << 19, 1 << 18


def rank(docs: DataFrame, queries: DataFrame, words: Column, query_words: Column, doc_id: str = "doc_id", query_id: str = "query_id", task_pairs: int = TASK_PAIRS) -> DataFrame:
    """query_id, doc_id, bm25: the summed score of every document that holds a word of the query; words that a query repeats count each
    time. Only terms of queries are counted. Documents are dealt out by id, so many to a task that its pairs with queries are about task_pairs at most, and meet
    the queries there: the pairs, far more than the words, are never shuffled, and no task grows with the corpus."""
    spark = docs.sparkSession
    asked = queries.select(query_id, F.explode(query_words).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("times"))
    totals, _ = corpus_stats(docs, words)
    n, q = totals.first(), asked.agg(F.count_distinct(query_id).alias("queries"), F.count("*").alias("words")).first()
    sent = F.broadcast if q["words"] <= SENT else (lambda df: df.hint("merge"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n["n_docs"] * q["queries"] // task_pairs))
    split = docs.select(doc_id, words.alias("words"))  # once a document, not once a word
    spread = split.select(doc_id, F.size("words").alias("length"), F.explode("words").alias("term")).join(sent(asked.select("term").distinct()), "term", "left_semi")
    tf = spread.repartition(parts, doc_id).groupBy(doc_id, "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    of_term = asked.groupBy("term").agg(F.collect_list(F.struct(query_id, "times")).alias("asked"))  # a row a word of the queries
    weighed = of_term.join(df, "term").withColumn("idf", idf(F.lit(n["n_docs"]), F.col("df"))).select("term", "idf", "asked")
    score = term_score(F.col("tf"), F.col("idf"), F.col("length"), F.lit(n["mean_length"]))
    scored = tf.join(sent(weighed), "term").select(doc_id, score.alias("score"), F.explode("asked").alias("of")).select(doc_id, "score", "of.*")
    return scored.groupBy(query_id, doc_id).agg(F.sum(F.col("score") * F.col("times")).alias("bm25"))
