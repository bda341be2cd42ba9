"""The index: a bundle of tables built by projections and explodes over the dictionary, one shuffle for each distinct.

base (base_id, ord, word, word_lc, fields), variant (variant, len, base_id, kind, lang, field, lang_ord, pos, ord), phonetic (code, base_id, lang), ngram (gram, base_id),
synonym (syn, base_id). Variants, phonetic codes and compounds come from one Arrow-batched function; all else is built-in."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import languages
from ..config import merge
from ..functions.text import languages_of, ngrams, strip_accents
from ..runtime import ship

TABLES = ("base", "variant", "phonetic", "ngram", "synonym")
#: Words from which the planner calls a dictionary inverted. Both kinds have the same tables and results; a large one is better saved
#: and loaded than cached.
INVERTED_FROM = 10_000
_FORMS = "array<struct<variant:string,kind:string,lang:string,lang_ord:int,pos:int>>"


@dataclass
class Index:
    base: DataFrame
    variant: DataFrame
    phonetic: DataFrame
    ngram: DataFrame
    synonym: DataFrame
    config: dict
    fields: list[str]

    def map(self, f) -> Index:
        return Index(*(f(getattr(self, t)) for t in TABLES), self.config, self.fields)

    def cache(self) -> Index:
        return self.map(lambda df: df.cache())

    def unpersist(self) -> Index:
        return self.map(lambda df: df.unpersist())

    def mode(self) -> str:
        large = self.config["use_bm25"] or self.base.limit(INVERTED_FROM).count() >= INVERTED_FROM
        return "inverted" if large else "classic"

    def stats(self) -> DataFrame:
        """Rows of each table."""
        return union([getattr(self, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows") for t in TABLES])


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def dealt(df: DataFrame) -> DataFrame:
    """df for a join by equality, in which it is dealt out by key. Spark takes what is exploded from a file to be as small as the file, and would send an index
    table of any size to all executors by way of the driver."""
    return df.hint("merge")


def detect_languages(words: DataFrame, word: str = "word", rows: int = 100) -> list[str]:
    """Languages of the first rows: a peek that takes a bounded number of rows, not a pass."""
    found = words.select(F.explode(languages_of(F.col(word))).alias("lang")).limit(4 * rows).distinct().collect()
    return [n for n in ("english", "german", "french", "spanish") if any(r["lang"] == n for r in found)]


def dictionary(source: DataFrame, word: str = "word", fields: list[str] | None = None, ord_col: str | None = None, min_length: int = 1) -> DataFrame:
    """base_id, ord, word, word_lc, fields: unique without case, the first spelling kept. base_id is ord_col, else a hash of the word, which no
    other partitioning changes. With fields, the first that is there names the row
    and the last row of a name gives the fields."""
    ord_ = F.col(ord_col).cast("long") if ord_col else F.monotonically_increasing_id()
    name = F.coalesce(*[F.col(f).cast("string") for f in fields], F.concat(F.lit("item_"), ord_)) if fields else F.col(word).cast("string")
    held = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]), lambda _, v: v.isNotNull()) if fields else F.lit(None).cast("map<string,string>")
    rows = source.select(ord_.alias("ord"), F.trim(name).alias("word"), held.alias("fields")).where(F.length("word") >= min_length)
    rows = rows.withColumn("word_lc", F.lower("word"))
    if fields:
        base = rows.groupBy("word_lc").agg(F.min_by("word", "ord").alias("word"), F.max_by("fields", "ord").alias("fields"), F.min("ord").alias("ord"))
    else:
        base = rows.groupBy("word_lc").agg(F.min_by("word", "ord").alias("word"), F.min("ord").alias("ord")).withColumn("fields", F.lit(None).cast("map<string,string>"))
    return base.select((F.col("ord") if ord_col else F.xxhash64("word_lc")).alias("base_id"), "ord", "word", "word_lc", "fields")


def custom_normalized(config: dict, text: Column) -> Column:
    """text by the caller's own function, if the settings have one. It is not saved with an index."""
    own = config.get("custom_normalizer")
    if own is None:
        return text

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: own(t) if t is not None else None)

    return run(text)


def _texts(base: DataFrame, fields: list[str]) -> DataFrame:
    """base_id, ord, text, field: what of each row is searched."""
    if not fields:
        return base.select("base_id", "ord", F.col("word").alias("text"), F.lit(None).cast("string").alias("field"))
    return base.select("base_id", "ord", F.explode("fields").alias("field", "text")).where("text <> ''").select("base_id", "ord", "text", "field")


def tables_of(base: DataFrame, config: dict, fields: list[str] | None = None) -> Index:
    """The index over base rows; also builds the delta for added words."""
    spark, names, features, performance = base.sparkSession, config["languages"], set(config["features"]), config["performance"]
    langs = languages.get(names)
    if not langs:
        raise ValueError(f"no known language in {names}")
    ship(spark)
    texts = _texts(base, fields or []).withColumn("text", custom_normalized(config, F.col("text")))

    @F.pandas_udf(_FORMS)
    def forms(words):
        import pandas as pd

        def of(word: str) -> list[tuple]:
            seen, out = set(), []
            for n, lang in enumerate(langs):
                plain = lang.normalize(strip_accents(word))
                made = [(lang.normalize(word).lower(), "normal"), (plain.lower(), "plain")]
                if "partial-words" in features:
                    made += [(v.lower(), "partial") for v in lang.variants(word, performance)]
                if "compound" in features and lang.name == "german" and (parts := lang.split_compound(word)) != [word]:
                    made += [(p.lower(), "compound") for p in parts if len(p) >= 3]
                for pos, (v, kind) in enumerate(made):
                    if v and v not in seen:
                        seen.add(v)
                        out.append((v, kind, lang.name, n, pos))
            return out

        return pd.Series([of(w) if w else [] for w in words])

    @F.pandas_udf("array<struct<code:string,lang:string>>")
    def codes(words):
        import pandas as pd

        return pd.Series([[(c, lang.name) for lang in langs if "phonetic" in lang.features and (c := lang.phonetic(w))] if w else [] for w in words])

    exploded = texts.select("base_id", "ord", "field", F.explode(forms("text")).alias("f")).select("base_id", "ord", "field", "f.*")
    first = F.struct("lang_ord", "pos")
    variant = exploded.groupBy("variant", "base_id", "field").agg(F.min("ord").alias("ord"), F.min_by(F.struct("kind", "lang", "lang_ord", "pos"), first).alias("x"))
    variant = variant.select("variant", F.length("variant").alias("len"), "base_id", "x.kind", "x.lang", "field", "x.lang_ord", "x.pos", "ord")
    none = lambda schema: spark.createDataFrame([], schema)
    phonetic = texts.select("base_id", F.explode(codes("text")).alias("c")).select("c.code", "base_id", "c.lang").distinct() if "phonetic" in features else none("code string, base_id long, lang string")
    parts, synonyms = [], []
    for lang in langs:
        normal = lang.normalized(F.col("text"))
        source = F.when(F.length(normal) > 10, F.substring(normal, 1, 15)).otherwise(normal) if performance == "fast" else normal
        parts.append(texts.where(F.length(normal) > 3).select(F.explode(ngrams(source, config["ngram_size"])).alias("gram"), "base_id"))
        known = [(head, s) for head, syns in (lang.synonyms | config["custom_synonyms"]).items() for s in syns]
        if "synonyms" in features and known:
            synonyms.append(texts.withColumn("head", normal).join(F.broadcast(spark.createDataFrame(known, "head string, syn string")), "head").select(F.lower("syn").alias("syn"), "base_id"))
    ngram = union(parts).distinct()
    synonym = union(synonyms).distinct() if synonyms else none("syn string, base_id long")
    return Index(base, variant, phonetic, ngram, synonym, config, fields or [])


def build(source: DataFrame, config: dict | None = None, word: str = "word", fields: list[str] | None = None, ord_col: str | None = None, progress=None) -> Index:
    """Index of source.word, or of several fields. languages ["auto"] looks at the first rows."""
    user = dict(config or {})
    if "auto" in user.get("languages", []):
        user["languages"] = detect_languages(source, (fields or [word])[0])
    settings = merge(user)
    index = tables_of(dictionary(source, word, fields, ord_col, settings["min_query_length"]), settings, fields)
    if progress:  # a table counts as done when it is there
        index = index.cache()
        for k, t in enumerate(TABLES, 1):
            getattr(index, t).count()
            progress(t, k, len(TABLES))
    return index


def delta(index: Index, source: DataFrame, word: str = "word", ord_col: str | None = None) -> Index:
    """The tables of the words of source that index doesn't have."""
    fresh = dictionary(source, word, index.fields or None, ord_col, index.config["min_query_length"]).join(dealt(index.base), "word_lc", "left_anti")
    top = index.base.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top"))
    shifted = fresh.crossJoin(F.broadcast(top)).withColumn("ord", F.col("ord") + F.col("top") + 1)  # top is one row
    base_id = F.col("ord") if ord_col else F.col("base_id")
    return tables_of(shifted.select(base_id.alias("base_id"), "ord", "word", "word_lc", "fields"), index.config, index.fields)


def joined(index: Index, other: Index) -> Index:
    return Index(*(getattr(index, t).unionByName(getattr(other, t)) for t in TABLES), index.config, index.fields)


def add(index: Index, source: DataFrame, word: str = "word", ord_col: str | None = None) -> Index:
    """The index with the words of source that it doesn't have. Only the new ones are worked on."""
    return joined(index, delta(index, source, word, ord_col))


def remove(index: Index, words: DataFrame, word: str = "word") -> Index:
    """The index without words (compared without case)."""
    gone = index.base.join(dealt(words.select(F.lower(F.trim(word)).alias("word_lc")).distinct()), "word_lc", "left_semi").select("base_id")
    return index.map(lambda df: df.join(dealt(gone), "base_id", "left_anti").select(*df.columns))


def save(index: Index, path: str, mode: str = "overwrite") -> None:
    """A Parquet table for each part; variants and grams in the order of their keys, so that reading a key skips most of a file."""
    keys = {"variant": "variant", "phonetic": "code", "ngram": "gram", "synonym": "syn", "base": "word_lc"}
    for t in TABLES:
        getattr(index, t).sortWithinPartitions(keys[t]).write.mode(mode).parquet(f"{path}/{t}")
    spark = index.base.sparkSession
    spark.createDataFrame([(json.dumps({"config": index.config | {"custom_normalizer": None}, "fields": index.fields, "version": 1}),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/config")


def load(spark: SparkSession, path: str) -> Index | None:
    """What save wrote; None if there is nothing."""
    from pyspark.errors import AnalysisException

    try:
        held = json.loads(spark.read.text(f"{path}/config").first()[0])
    except AnalysisException:
        return None
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in TABLES), held["config"], held["fields"])


def serialized_size(index: Index) -> DataFrame:
    """Bytes of the rows of each table as JSON."""
    return union([getattr(index, t).agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).select(F.lit(t).alias("name"), "bytes") for t in TABLES])


