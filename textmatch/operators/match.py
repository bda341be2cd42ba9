"""Matchers: each joins the queries with an index table by an equality and gives candidates in one schema.

candidate: query_id, base_id, lang_ord, step, type, edit_distance, variant, kind, field, vord. Prefixes join on the beginning of a variant at the
lengths that queries have, substrings on their first letters, fuzzy matches on shared pieces: a variant cut into more pieces
than its edits can touch leaves one piece whole, near its old place in the query. So no matcher compares all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import damerau_levenshtein
from ..functions.text import matches_wildcard, ngrams, starts_word
from ..languages import Language
from .index import Index, custom_normalized, dealt, union

#: Matchers in the order in which they are folded.
STEPS = ("exact", "prefix", "substring", "phonetic", "synonym", "ngram", "fuzzy")
_COLUMNS = ("query_id", "base_id", "lang_ord", "step", "type", "edit_distance", "variant", "kind", "field", "vord")


def _candidates(df: DataFrame, n: int, step: str, edit: Column | None = None, kind: str | None = None, also: list[Column] | None = None) -> DataFrame:
    """Puts joined rows into the schema; those without a variant get nulls."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    vord = F.struct(F.col("ord"), F.col("v_lang_ord").alias("lang_ord"), F.col("pos")) if "pos" in df.columns else F.struct(F.lit(0).cast("long").alias("ord"), F.lit(0).alias("lang_ord"), F.lit(0).alias("pos"))
    type_ = F.when(F.col("kind") == "compound", "compound").otherwise(step) if step == "exact" and kind is None and "kind" in df.columns else F.lit(step)
    return df.select(
        "query_id", "base_id", F.lit(n).alias("lang_ord"), F.lit(STEPS.index(step)).alias("step"), type_.alias("type"), (edit if edit is not None else F.lit(None)).cast("int").alias("edit_distance"),
        has("variant").cast("string").alias("variant"), has("kind").cast("string").alias("kind"), has("field").cast("string").alias("field"), vord.alias("vord"), *(also or []),
    )


def max_distance(length: Column, limit: int) -> Column:
    return F.when(length <= 3, 2).when(length == 4, max(limit, 2)).when(length <= 9, limit).otherwise(max(limit, 3))


def _cut(text: Column, n: int) -> Column:
    """n pieces of a text, as even as can be, by number."""
    at = lambda i: F.floor(i * F.length(text) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("no"), F.substring(text, at(i) + 1, at(i + 1) - at(i)).alias("piece")))


def _probes(text: Column, n: int, d: int) -> Column:
    """What a text with d edits or fewer must share one of: for each length, piece number and shift, (len, no, piece)."""

    def of_length(length: Column) -> Column:
        at = lambda i: F.floor(i * length / n).cast("int")
        shifts = F.sequence(F.lit(-d), F.lit(d))
        piece = lambda i, s: F.struct(length.alias("len"), i.alias("no"), F.substring(text, at(i) + s + 1, at(i + 1) - at(i)).alias("piece"), (at(i) + s).alias("from"), (at(i + 1) - at(i)).alias("size"))
        all_ = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(shifts, lambda s: piece(i, s))))
        return F.filter(all_, lambda p: (p["from"] >= 0) & (p["size"] > 0) & (F.length(p["piece"]) == p["size"]))

    lengths = F.filter(F.sequence(F.length(text) - d, F.length(text) + d), lambda x: x >= n)
    return F.array_distinct(F.transform(F.flatten(F.transform(lengths, of_length)), lambda p: F.struct(p["len"].alias("len"), p["no"].alias("no"), p["piece"].alias("piece"))))


#: Up to so many queries are sent to the variants and compared with each; more meet them by keys.
FEW = 32


def are_few(queries: DataFrame) -> bool:
    return queries.limit(FEW + 1).count() <= FEW


def fuzzy_pairs(queries: DataFrame, variants: DataFrame, limit: int, transpositions: bool, few: bool = False) -> DataFrame:
    """queries (query_id, nq) with variants (variant, len, ...) within their distance, and the distance: query_id, variant, edit. Every pair within it is
    found, by shared pieces, or if there are few queries by comparing lengths first."""
    asked = queries.where("nq <> ''").withColumn("d", max_distance(F.length("nq"), limit))
    classes = sorted({2, max(limit, 2), limit, max(limit, 3)} - {0})
    wide = 2 if transpositions else 1
    within = F.levenshtein("variant", "nq", wide * classes[-1])
    own = variants.select("variant", "len").distinct()
    if few:
        pairs = own.join(F.broadcast(asked), F.abs(F.col("len") - F.length("nq")) <= F.col("d")).withColumn("lev", within)
    else:
        number = {d: wide * d + 1 for d in classes}
        placed = lambda d, x: F.transform(x, lambda c: F.struct(F.lit(d).alias("d"), c["no"].alias("no"), c["piece"].alias("piece")))
        none = F.array().cast("array<struct<d:int,no:int,piece:string>>")
        cuts = F.concat(*[F.when(F.col("len") >= n, placed(d, _cut(F.col("variant"), n))).otherwise(none) for d, n in number.items()])
        pieces = own.select("variant", "len", F.explode(cuts).alias("c")).select("variant", "len", "c.*")
        probe = "array<struct<len:int,no:int,piece:string>>"
        probes = F.concat(*[F.when(F.col("d") == d, _probes(F.col("nq"), n, d).cast(probe)).otherwise(F.array().cast(probe)) for d, n in number.items()])
        probes = asked.select("query_id", "nq", "d", F.explode(probes).alias("p")).select("query_id", "nq", "d", "p.*")
        long_ = probes.join(dealt(pieces), ["d", "len", "no", "piece"]).select("query_id", "nq", "d", "variant")
        # texts shorter than the number of pieces have no whole one; they meet by length
        least = F.create_map(*[F.lit(x) for dn in number.items() for x in dn])
        sized = asked.select("query_id", "nq", "d", F.explode(F.sequence(F.length("nq") - F.col("d"), F.length("nq") + F.col("d"))).alias("len")).where(F.col("len") < F.element_at(least, F.col("d")))
        short = sized.join(dealt(own.where(F.col("len") < max(number.values()))), "len").select("query_id", "nq", "d", "variant")
        pairs = long_.unionByName(short).withColumn("lev", within)
    pairs = pairs.where((F.col("lev") >= 0) & (F.col("lev") <= wide * F.col("d"))).select("query_id", "nq", "d", "variant", "lev")
    pairs = pairs if few else pairs.distinct()
    edit = F.when(F.col("lev") <= 1, F.col("lev")).otherwise(damerau_levenshtein(F.col("variant"), F.col("nq"))) if transpositions else F.col("lev")
    return pairs.withColumn("edit", edit).where("edit <= d").select("query_id", "variant", "edit")


def highest(config: dict, step: str) -> float:
    """The highest score that a match of this kind can get, but for BM25."""
    return (config["scores"][step] + max(0.0, config["modifiers"]["short_word_boost"])) * max([1.0, *map(float, config["field_weights"].values())])


def candidates(queries: DataFrame, index: Index, language: Language, n: int, word_boundaries: bool | None = None, few: bool = False, least: float = 0.0) -> DataFrame:
    """All candidates of one language's pass. queries: query_id, query. few: see FEW. least: a score that no phonetic, synonym or n-gram match below it is
    needed for; these never stand in another's way, so a matcher that cannot reach it is left out."""
    config = index.config
    features, edge = set(config["features"]), config["word_boundaries"] if word_boundaries is None else word_boundaries
    text = custom_normalized(config, F.col("query"))
    asked = queries.select("query_id", "query", F.lower(language.normalized(text)).alias("nq"))
    variant = index.variant.withColumnRenamed("lang_ord", "v_lang_ord")
    whole = lambda df: df.where(starts_word(F.col("variant"), F.col("nq"))) if edge else df
    sent = F.broadcast if few else (lambda df: df)
    plain = asked.where(~F.col("query").contains("*"))
    can = lambda step: highest(config, step) >= least
    out = [_candidates(sent(plain).join(dealt(index.base), F.col("nq") == F.col("word_lc")).withColumn("variant", F.col("word_lc")), n, "exact", F.lit(0), kind="base")]
    stars = asked.where(F.col("query").contains("*"))
    out.append(_candidates(_by_wildcard(sent(stars), index.base), n, "exact", F.lit(0), kind="base"))

    begins = F.startswith("variant", F.col("nq"))
    if few:  # one pass over the variants for all three
        small = F.broadcast(asked.where("nq <> ''"))
        same = (F.col("variant") == F.col("nq")) & ~F.col("query").contains("*")
        found = variant.join(small, F.contains("variant", F.col("nq")))
        first = starts_word(F.col("variant"), F.col("nq")) if edge else F.lit(True)
        step = F.when(begins & (F.col("len") > F.length("nq")) & first, "prefix").when(same & first, "exact").when(~begins & (F.length("nq") >= 2), "substring")
        found = found.withColumn("matcher", step).where("matcher is not null")
        type_ = F.when((F.col("matcher") == "exact") & (F.col("kind") == "compound"), "compound").otherwise(F.col("matcher"))
        number = F.array_position(F.array(*map(F.lit, STEPS)), F.col("matcher")).cast("int") - 1
        one = _candidates(found, n, "exact", F.when(F.col("matcher") == "exact", 0), kind="any", also=[number.alias("step_of"), type_.alias("type_of")])
        out.append(one.withColumn("step", F.col("step_of")).withColumn("type", F.col("type_of")))
    else:
        out.append(_candidates(whole(plain.join(dealt(variant), F.col("nq") == F.col("variant"))), n, "exact", F.lit(0)))
        sizes = asked.select(F.length("nq").alias("size")).where("size > 0").distinct()
        heads = variant.join(F.broadcast(sizes), F.col("len") > F.col("size")).withColumn("head", F.expr("substring(variant, 1, size)"))  # a row for each length of a query
        out.append(_candidates(whole(asked.join(dealt(heads), F.col("nq") == F.col("head"))), n, "prefix"))
        out.append(_candidates(_inside(asked, variant), n, "substring"))

    if "phonetic" in features and "phonetic" in language.features and can("phonetic"):
        @F.pandas_udf("string")
        def code(words):
            return words.map(lambda w: language.phonetic(w) if w else None)

        out.append(_candidates(sent(asked.withColumn("code", code("query")).where("code <> ''")).join(dealt(index.phonetic.select("code", "base_id").distinct()), "code"), n, "phonetic"))
    if "synonyms" in features and can("synonym"):
        out.append(_candidates(sent(asked).join(dealt(index.synonym), F.col("nq") == F.col("syn")), n, "synonym"))
    if can("ngram"):
        size = config["ngram_size"]
        grams = asked.where(F.length("nq") >= size).select("query_id", F.explode(F.array_distinct(ngrams(F.col("nq"), size))).alias("gram"))
        out.append(_candidates(sent(grams).join(dealt(index.ngram), "gram").select("query_id", "base_id").distinct(), n, "ngram"))
    if features & {"missing-letters", "extra-letters", "transpositions"}:
        pairs = fuzzy_pairs(asked.select("query_id", "nq"), variant, config["max_edit_distance"], "transpositions" in features, few)
        out.append(_candidates(pairs.join(dealt(variant), "variant"), n, "fuzzy", F.col("edit")))
    return union([c.select(*_COLUMNS) for c in out])


def _inside(asked: DataFrame, variant: DataFrame, size: int = 3) -> DataFrame:
    """Queries with the variants that hold them, not at the beginning. They meet by the gram of the query that the fewest variants have, a short query by the
    whole of it, so a gram that many words share draws nothing to it unless a query is made of such grams only."""
    grams = lambda c, k: F.array_distinct(ngrams(c, k))
    own = variant.where("len >= 2").withColumn("key", F.explode(F.concat(grams(F.col("variant"), size), F.when(F.col("len") >= 2, grams(F.col("variant"), 2)).otherwise(F.array().cast("array<string>")))))
    asked = asked.where(F.length("nq") >= 2)
    often = own.groupBy("key").agg(F.count("*").alias("n"))
    of_query = asked.select("query_id", F.explode(grams(F.col("nq"), size)).alias("key")).join(dealt(often), "key")
    rarest = of_query.groupBy("query_id").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    found = asked.join(rarest, "query_id").join(dealt(own), "key")
    return found.where(F.contains("variant", F.col("nq")) & ~F.startswith("variant", F.col("nq"))).dropDuplicates(["query_id", "base_id", "variant", "field"])


def _by_wildcard(stars: DataFrame, base: DataFrame) -> DataFrame:
    """Queries with a * and the words that they fit: those that begin with letters meet words by the first of them, others are compared with all."""
    head = F.lower(F.substring_index("query", "*", 1))
    stars = stars.withColumn("head", F.substring(head, 1, 2)).withColumn("size", F.length("head"))
    keyed = base.withColumn("size", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("head", F.expr("substring(word_lc, 1, size)"))
    by_key = stars.where("size > 0").join(dealt(keyed), ["size", "head"])
    rest = F.broadcast(stars.where("size = 0").drop("size", "head")).join(base, F.lit(True))  # a stated set of queries without a beginning
    found = by_key.drop("size", "head").unionByName(rest)
    return found.where(matches_wildcard(F.col("word"), F.col("query"))).withColumn("variant", F.col("word_lc"))


def folded(found: DataFrame) -> DataFrame:
    """query_id, base_id and the match that stands: languages in order, matchers in order within one.

    exact replaces all but exact; prefix, phonetic, synonym and ngram fill what is empty; substring replaces all but exact and prefix;
    fuzzy replaces what is neither, if its distance is smaller (others count as infinite)."""
    row = "struct<lang_ord:int,step:int,edit_distance:int,vord:struct<ord:bigint,lang_ord:int,pos:int>,type:string,variant:string,kind:string,field:string>"
    item = F.struct("lang_ord", "step", F.coalesce("edit_distance", F.lit(0)).alias("edit_distance"), "vord", "type", "variant", "kind", "field")
    held = found.groupBy("query_id", "base_id").agg(F.sort_array(F.collect_list(item)).alias("all"), F.collect_set("field").alias("match_fields"))  # the forms of one word

    def step(a: Column, x: Column) -> Column:
        top = a["type"].isin("exact", "compound")
        better = F.when(a.isNull(), True).when(x["step"] == 0, ~top | (a["type"] == "compound") & (x["type"] == "exact")).when(top | (a["type"] == "prefix"), False)
        better = better.when(x["type"] == "substring", True).when(x["type"] == "fuzzy", (a["type"] != "fuzzy") | (x["edit_distance"] < a["edit_distance"])).otherwise(False)
        return F.when(better, x).otherwise(a)

    best = F.aggregate("all", F.lit(None).cast(row), lambda a, x: step(a, x.cast(row)))
    return held.select("query_id", "base_id", "match_fields", best.alias("m")).select("query_id", "base_id", "match_fields", "m.*")
