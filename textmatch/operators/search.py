"""Search: match, fold, score, filter, sort, top k; one plan for a batch of queries."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import languages
from ..functions.facets import apply_filters, apply_sort
from ..functions.ranking import rank, squashed
from ..functions.text import drop_stop_words, tokens
from .highlight import highlights
from .index import Index, build, dealt, union
from .match import are_few, candidates, folded
from .score import score

OPTIONS = {"limit": None, "threshold": None, "languages": None, "match_types": None, "filters": None, "sort": None, "highlight": False, "word_boundaries": None, "strict": False, "bm25": None}


def as_queries(spark: SparkSession, queries) -> DataFrame:
    """query_id, query from a string, a list or a DataFrame; equal queries are one."""
    if isinstance(queries, DataFrame):
        return queries.select("query_id", "query")
    texts = [queries] if isinstance(queries, str) else list(dict.fromkeys(queries))
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def matches(index: Index, queries: DataFrame, **options) -> DataFrame:
    """Scored matches at or above the threshold, without rank or limit: query_id, query, base_id, display, base_word, is_synonym, score,
    language, match_type, edit_distance, field, fields."""
    opt, config = OPTIONS | options, index.config
    asked = queries.where(F.length("query") >= config["min_query_length"])
    if config["enable_stop_words"] and config["stop_words"]:
        asked = asked.withColumn("query", drop_stop_words(F.col("query"), config["stop_words"]))
    langs, few = languages.get(opt["languages"] or config["languages"]), are_few(asked)
    bm25 = config["use_bm25"] if opt["bm25"] is None else opt["bm25"]
    least = 0.0 if bm25 else opt["threshold"] or config["fuzzy_threshold"]
    found = folded(union([candidates(asked, index, lang, n, opt["word_boundaries"], few, least) for n, lang in enumerate(langs)]))
    rows = found.join(F.broadcast(asked) if few else asked, "query_id").join(dealt(index.base), "base_id")
    name = F.element_at(F.array(*[F.lit(x.name) for x in langs]), F.col("lang_ord") + 1)
    value = score(config, F.col("type"), F.col("query"), F.col("word"), F.coalesce("variant", "word_lc"), F.col("edit_distance"), F.lower("query"), opt["strict"])
    if config["field_weights"] and not opt["strict"]:
        weights = F.create_map(*[F.lit(x) for f, w in config["field_weights"].items() for x in (f, float(w))])
        weight = F.array_max(F.transform("match_fields", lambda f: F.coalesce(F.element_at(weights, f), F.lit(1.0))))
        value = F.least(F.lit(1.0), value * F.coalesce(weight, F.lit(1.0)))
    rows = rows.withColumn("score", value)
    if bm25:
        words = tokens(F.col("word"))
        ranked = rank(index.base.select("base_id", "word"), asked, words, tokens(F.col("query")), "base_id")
        w = config["bm25_weight"] or 0.6
        blend = w * squashed(F.coalesce("bm25", F.lit(0.0))) + (1 - w) * F.col("score")
        rows = rows.join(dealt(ranked), ["query_id", "base_id"], "left").withColumn("score", blend)
    out = rows.where(F.col("score") >= (opt["threshold"] or config["fuzzy_threshold"])).select(
        "query_id", "query", "base_id", F.col("word").alias("display"), F.col("word").alias("base_word"), (F.col("type") == "synonym").alias("is_synonym"), "score",
        F.when(F.col("type") == "synonym", "synonym").otherwise(name).alias("language"), F.col("type").alias("match_type"), F.when(F.col("type").isin("exact", "fuzzy"), F.col("edit_distance")).alias("edit_distance"), "field", "fields",
    )
    if opt["match_types"]:
        out = out.where(F.col("match_type").isin(opt["match_types"]))
    return out


def ranked(rows: DataFrame, limit: int | None = None, filters: dict | None = None, sort: dict | None = None) -> DataFrame:
    """rows with rank, at most limit a query. Facets are fields of the record; sort holds primary, secondary, keep_relevance."""
    if filters:
        of = lambda f: F.element_at("fields", F.lit(f))
        rows = apply_filters(rows, filters, of)
    keys = [F.desc("score")]
    if sort:
        used = [s["field"] for s in (sort["primary"], sort.get("secondary")) if s and s["field"] not in rows.columns]
        rows = rows.withColumns({f: F.element_at("fields", F.lit(f)) for f in used})
        keys = apply_sort(rows, sort["primary"], sort.get("secondary"), keep_relevance=sort.get("keep_relevance", True))
        rows_out = [c for c in rows.columns if c not in used]
    else:
        rows_out = rows.columns
    order = Window.partitionBy("query_id").orderBy(*keys, F.desc(F.col("match_type") == "phrase_term"), "base_word", "base_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).select(*rows_out, "rank")
    return rows.where(F.col("rank") <= limit) if limit else rows


def search(index: Index, queries, **options) -> DataFrame:
    """The best matches of each query. See OPTIONS; limit and threshold 0 mean the settings' own."""
    opt = OPTIONS | options
    unknown = set(options) - set(OPTIONS)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}")
    asked = as_queries(index.base.sparkSession, queries)
    out = ranked(matches(index, asked, **options), opt["limit"] or index.config["max_results"], opt["filters"], opt["sort"])
    if opt["highlight"]:
        out = out.withColumn("highlights", highlights(F.col("base_word"), F.col("query"), F.col("match_type")))
    return out


def batch(index: Index, queries: list[str], **options) -> DataFrame:
    """query and the array of its results, best first; queries without results have an empty one."""
    asked = as_queries(index.base.sparkSession, queries)
    found = search(index, asked, **options)
    nested = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "display", "score", "match_type", "language"))).alias("results"))
    empty = F.array().cast("array<struct<rank:int,display:string,score:double,match_type:string,language:string>>")
    return asked.join(nested, "query_id", "left").select("query_id", "query", F.coalesce("results", empty).alias("results"))


class Cache:
    """Results of the last queries, on the driver; the least recently used go first."""

    def __init__(self, capacity: int = 100):
        self.capacity, self.held, self.hits, self.misses = capacity, OrderedDict(), 0, 0

    def get(self, key):
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key]
        self.misses += 1
        return None

    def put(self, key, value) -> None:
        self.held[key] = value
        self.held.move_to_end(key)
        while len(self.held) > self.capacity:
            self.held.popitem(last=False)

    def clear(self) -> None:
        self.held.clear()
        self.hits = self.misses = 0

    def stats(self) -> dict:
        n = self.hits + self.misses
        return {"size": len(self.held), "capacity": self.capacity, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / n if n else 0.0}


class Searcher:
    """An index with a cache of collected results. Changing the index clears it."""

    def __init__(self, index: Index, capacity: int = 100):
        self._index, self.cache = index, Cache(capacity)

    @property
    def index(self) -> Index:
        return self._index

    @index.setter
    def index(self, index: Index) -> None:
        self._index = index
        self.cache.clear()

    def search(self, query: str, **options) -> list:
        key = (query, repr(sorted(options.items(), key=lambda kv: kv[0])))
        if (rows := self.cache.get(key)) is None:
            rows = search(self._index, query, **options).orderBy("rank").collect()  # at most limit rows
            self.cache.put(key, rows)
        return rows


def create(source: DataFrame, config: dict | None = None, **build_options) -> Searcher:
    """A searcher over source with English, balanced settings and five results unless config says otherwise."""
    return Searcher(build(source, {"languages": ["english"], "max_results": 5} | (config or {}), **build_options))
