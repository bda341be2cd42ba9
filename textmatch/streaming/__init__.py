"""Structured Streaming around an index: words that arrive are added, queries that arrive are answered.

An index on disk is a base and a delta for each batch, named by the batch's number. A batch that is replayed reads what came before it and writes its
delta again, so nothing is read that is being written, and the cost of a batch is that of its new words. compact() folds the deltas into a new base."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import Index, delta, joined, load, save
from ..operators.search import search


def _names(spark, path: str) -> list[str]:
    """Names below path of what is whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(x.getPath().getName() for x in store.listStatus(at) if store.exists(done(x.getPath(), "config/_SUCCESS")))


def _parts(spark, path: str, before: int | None = None) -> tuple[str, int, list[str]]:
    """The base, the last batch that it holds (-1: none), and the deltas behind it, up to the batch before."""
    base = spark.read.text(f"{path}/current").first()[0]
    held = int(base.rpartition("-")[2]) - 1
    number = lambda name: int(name.rpartition("-")[2])
    deltas = [n for n in _names(spark, path) if re.fullmatch("delta-[0-9]+", n) and number(n) > held and (before is None or number(n) < before)]
    return base, held, deltas


def _loaded(spark, path: str, base: str, deltas: list[str]) -> Index:
    out = load(spark, f"{path}/{base}")
    for name in deltas:
        out = joined(out, load(spark, f"{path}/{name}"))
    return out


def _point(spark, path: str, base: str) -> None:
    spark.createDataFrame([(base,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")


def keep_indexed(words: DataFrame, path: str, checkpoint: str, word: str = "word"):
    """Starts a query that adds each batch of new words to the index published at path; current() finds the last state."""

    def run(batch: DataFrame, number: int) -> None:
        add_batch(batch, path, number, word)

    return words.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def add_batch(batch: DataFrame, path: str, number: int, word: str = "word") -> None:
    """Writes the delta of a batch; the same batch again writes the same. A batch that the base holds is left alone."""
    spark = batch.sparkSession
    base, held, deltas = _parts(spark, path, number)
    if number > held:
        save(delta(_loaded(spark, path, base, deltas), batch.withColumn("__ord", F.lit(0).cast("long")), word), f"{path}/delta-{number:09d}")


def publish(index: Index, path: str) -> None:
    save(index, f"{path}/base-{0:09d}")
    _point(index.base.sparkSession, path, f"base-{0:09d}")


def compact(spark, path: str) -> None:
    """Folds the deltas into a base of its own; the old base and deltas stay for those who read them."""
    base, _, deltas = _parts(spark, path)
    if deltas:
        name = f"base-{int(deltas[-1].rpartition('-')[2]) + 1:09d}"
        save(_loaded(spark, path, base, deltas), f"{path}/{name}")
        _point(spark, path, name)


def current(spark, path: str) -> Index:
    base, _, deltas = _parts(spark, path)
    return _loaded(spark, path, base, deltas)


def answer(queries: DataFrame, index: Index, sink, checkpoint: str, **options):
    """Starts a query that gives each batch of queries (query_id, query) with its results to sink(frame, batch number)."""
    return queries.writeStream.foreachBatch(lambda batch, n: sink(search(index, batch, **options), n)).option("checkpointLocation", checkpoint).start()
