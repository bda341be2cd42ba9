"""From a parsed query to one plan: AND is a semi join, OR a union that keeps the best score, NOT an anti join against the base."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import Index, dealt
from ..operators.phrase import phrase_search
from ..operators.search import matches, ranked
from . import And, InField, InLanguage, Not, Or, Phrase, QueryTimeout, Scored, Term, Typed, parse, unwrap

MAX_LENGTH = 10_000
_SCORES = {">": lambda s, v: s > v, ">=": lambda s, v: s >= v, "<": lambda s, v: s < v, "<=": lambda s, v: s <= v}


def _one(index: Index, text: str) -> DataFrame:
    return index.base.sparkSession.createDataFrame([(0, text)], "query_id long, query string")


class Compiler:
    def __init__(self, index: Index, allow_regex: bool = False, **options):
        self.index, self.allow_regex, self.options, self.seen = index, allow_regex, options, {}

    def rows(self, node) -> DataFrame:
        """Matches of a node; a node that occurs twice is one plan."""
        if node not in self.seen:
            self.seen[node] = self._rows(node)
        return self.seen[node]

    def _rows(self, node) -> DataFrame:
        match node:
            case Term(text):
                return matches(self.index, _one(self.index, text), **self.options)
            case Phrase(text):
                got = phrase_search(self.index, _one(self.index, f'"{text}"'), limit=1 << 30, **self.options)
                return got.drop("rank")
            case Typed("regex", text):
                return self._regex(text)
            case Typed(kind, text):
                return self.rows(Term(text)).where(F.col("match_type") == kind)
            case InField(name, child):
                return self.rows(child).where(F.col("field") == name) if self.index.fields else self.rows(child)
            case InLanguage(name, child):
                return self.rows(child).where(F.lower("language") == name)
            case Scored(child, op, value):
                return self.rows(child).where(_SCORES[op](F.col("score"), value))
            case And(left, Not(right)):
                return self.rows(left).join(dealt(self.rows(right).select("base_id").distinct()), "base_id", "left_anti").select(*self.rows(left).columns)
            case And(left, right):
                return self.rows(left).join(dealt(self.rows(right).select("base_id").distinct()), "base_id", "left_semi").select(*self.rows(left).columns)
            case Or(left, right):
                both = self.rows(left).withColumn("side", F.lit(0)).unionByName(self.rows(right).withColumn("side", F.lit(1)))
                item = F.struct(*both.columns)
                best = both.groupBy("base_id").agg(F.max_by(item, F.struct("score", -F.col("side"))).alias("x"))
                return best.select("x.*").drop("side")
            case Not(child):
                return self._all("not", F.lit(0.0)).join(dealt(self.rows(child).select("base_id").distinct()), "base_id", "left_anti").select(*self._all("not", F.lit(0.0)).columns)
        raise TypeError(node)

    def _all(self, kind: str, value) -> DataFrame:
        return self.index.base.select(
            F.lit(0).cast("long").alias("query_id"), F.lit("").alias("query"), "base_id", F.col("word").alias("display"), F.col("word").alias("base_word"), F.lit(False).alias("is_synonym"), value.alias("score"),
            F.lit("unknown").alias("language"), F.lit(kind).alias("match_type"), F.lit(None).cast("int").alias("edit_distance"), F.lit(None).cast("string").alias("field"), "fields",
        )

    def _regex(self, pattern: str) -> DataFrame:
        if not self.allow_regex:
            raise ValueError("regular expressions are not allowed; pass allow_regex")
        return self._all("regex", F.lit(1.0)).where(F.col("base_word").rlike(pattern))


def fql(index: Index, query: str, limit: int | None = None, allow_regex: bool = False, filters: dict | None = None, sort: dict | None = None, max_length: int = MAX_LENGTH, **options) -> DataFrame:
    """Ranked rows of a query, with or without fql(...) around it."""
    if len(query) > max_length:
        raise ValueError("the query is too long")
    inner = unwrap(query)
    node = parse(query if inner is None else inner)
    return ranked(Compiler(index, allow_regex, **options).rows(node), limit or index.config["max_results"], filters, sort)


def collect(frame: DataFrame, seconds: float = 5.0) -> list:
    """Rows of a plan, or QueryTimeout; its jobs are cancelled then."""
    sc, group = frame.sparkSession.sparkContext, f"fql-{id(frame)}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "query", interruptOnCancel=True)
    timer.start()
    try:
        return frame.collect()
    except Exception:
        if late.is_set():
            raise QueryTimeout(f"the query took more than {seconds} s") from None
        raise
    finally:
        timer.cancel()
        sc._jsc.clearJobGroup()
