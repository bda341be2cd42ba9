"""What the operators of this subpackage share: words, whole-text reading, let bindings, folds, tables that cut lineage, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are neither a space nor U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, chunk: int = 256) -> Column:
    """Arrays (of kind) that step(state, item) -> (state, array) gives for items from left to right, as one array. Outputs are gathered by chunks, so the cost is
    linear in practice, where appending to one array would be quadratic."""
    none = F.array().cast(f"array<{kind}>")

    def run(part: Column, state: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            state, out = step(a["s"], x)
            return F.struct(state.alias("s"), F.concat(a["o"], out).alias("o"))

        return F.aggregate(part, F.struct(state.alias("s"), none.alias("o")), one)

    def chunked(all_: Column) -> Column:
        def one(a: Column, k: Column) -> Column:
            part = F.transform(F.sequence(k * chunk, F.least((k + 1) * chunk, F.size(all_)) - 1), lambda i: F.get(all_, i))
            return let(run(part, a["s"]), lambda r: F.struct(r["s"].alias("s"), F.concat(a["o"], F.array(r["o"])).alias("o")))

        zero = F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o"))
        chunks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / chunk).cast("int"))
        return F.flatten(F.aggregate(chunks, zero, one)["o"])

    return let(items, lambda x: F.when(F.size(x) > chunk, chunked(x)).when(F.size(x) > 0, run(x, start)["o"]).otherwise(none))


#: Code points of a chunk of a text that is cut at many places.
CUT = 64


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))


def cut_of(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text (chunks: see chunks_of), in time that does not depend on where they are."""
    first = F.floor(start / CUT).cast("int")
    part = F.transform(F.sequence(first, F.floor((end - 1) / CUT).cast("int")), lambda i: F.get(chunks, i))
    return F.when(end <= start, F.lit("")).otherwise(F.substring(F.array_join(part, ""), start - first * CUT + 1, end - start))


def words_of(text: Column) -> Column:
    """Words of a text in order; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets a temporary one; on a
    cluster that would be one machine's disk, so it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            at = held.get()
        elif spark.sparkContext.master.partition("[")[0] == "local":
            at = tempfile.mkdtemp(prefix="textmatch-")
            spark.sparkContext.setCheckpointDir(at)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/textmatch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Row groups of tables; a writing task holds one in memory.
ROW_GROUP = 1 << 24
_tables: list[str] = []


def table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read from there: lineage is cut, lost executors cost nothing, and the optimizer sees the true size."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    _tables.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tm_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are made inside are deleted at the end, but for those given to what it yields, which returns them."""
    before, kept = set(_tables), set()

    def keep(t: DataFrame) -> DataFrame:
        kept.add(t._tm_path)
        return t

    try:
        yield keep
    finally:
        _delete(spark, [p for p in _tables if p not in before | kept])


def drop(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, [t._tm_path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        drop_path(spark, path)
        _tables.remove(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of this run in the shared folder, whatever the store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the application, wherever they run and whatever their path is."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent.parent
        at = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(at)
        _shipped.add(app)


#: Bytes of an Arrow batch on its way to Python (a longer row is a batch of its own).
BATCH_BYTES = 1 << 22


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow with this package at hand on the workers. Batches are bounded by their bytes (a session setting, only ever lowered), and
    a worker gives its memory back when a task ends, since it outlives the task."""
    spark = df.sparkSession
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, str(1 << 30)))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Return freed memory of this process to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library
