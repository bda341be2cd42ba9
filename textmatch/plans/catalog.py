"""Queries by name over the tables of a folder, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import languages
from ..fql.compile import fql
from ..functions import distance, facets, ranking, text
from ..operators import highlight, index, match, phrase, search
from ..runtime import ship
from ..sources import content

QUERY = "bolt"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _names(spark, sf_dir) -> DataFrame:
    """Distinct part names."""
    return _read(spark, sf_dir, "part").select(F.col("p_name").alias("word")).distinct()


def _index(spark, sf_dir, **config):
    return index.build(_names(spark, sf_dir), {"languages": ["english"]} | config)


def _letters_index(spark, sf_dir):
    """The part names, searched by exact, prefix, substring, n-gram and edit-distance matches; SQL can say what these give."""
    return _index(spark, sf_dir, features=["missing-letters"])


def search_slice(spark, sf_dir):
    """The ten best part names for one word."""
    got = search.search(_letters_index(spark, sf_dir), QUERY, limit=10)
    return got.select(F.col("display").alias("word"), "match_type", F.round("score", 6).alias("score"))


def _tokens(spark, sf_dir) -> DataFrame:
    """Distinct words of the documents, without accents."""
    docs = _read(spark, sf_dir, "documents").select(F.explode(text.tokens(text.remove_accents(F.col("text")), 3)).alias("variant")).distinct()
    return docs.withColumn("len", F.length("variant"))


def _nations(spark, sf_dir) -> DataFrame:
    both = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.lower("n_name").alias("nq"))
    return both.unionByName(_read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("query_id"), F.lower("r_name").alias("nq")))


def fuzzy_join(spark, sf_dir):
    """Nation and region names against all words of the documents, by edit distance."""
    got = match.fuzzy_pairs(_nations(spark, sf_dir), _tokens(spark, sf_dir), 2, False)
    return got.select("query_id", "variant", F.col("edit").cast("int").alias("edit"))


def fuzzy_join_transpositions(spark, sf_dir):
    got = match.fuzzy_pairs(_nations(spark, sf_dir), _tokens(spark, sf_dir), 2, True)
    return got.select("query_id", "variant", F.col("edit").cast("int").alias("edit"))


def normalized(spark, sf_dir):
    """Digest of each text as each language normalizes it."""
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", *[F.md5(lang.normalized(F.coalesce("text", F.lit("")))).alias(lang.name) for lang in languages.get(["english", "german", "spanish", "french"])])


def accents(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(text.remove_accents(t)).alias("plain"), text.has_accents(t).alias("marked"))


def tokenized(spark, sf_dir):
    t = text.tokens(F.coalesce("text", F.lit("")))
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("digest"))


def gram_jaccard(spark, sf_dir):
    """Likeness of every distinct name and type of the parts that share a gram."""
    part = _read(spark, sf_dir, "part").select("p_name", F.lower("p_type").alias("p_type")).distinct()
    return part.select("p_name", "p_type", F.round(distance.jaccard(F.lower("p_name"), F.col("p_type")), 6).alias("jaccard"), distance.levenshtein(F.lower("p_name"), F.col("p_type"), 5).cast("int").alias("distance"))


def segmented(spark, sf_dir):
    c = F.col("c_name")
    return _read(spark, sf_dir, "customer").select("c_custkey", text.alpha_part(c).alias("alpha"), text.numeric_part(c).alias("digits"), text.is_alphanumeric(c).alias("mixed"), F.array_join(text.segments(c), "|").alias("segments"))


def without_stop_words(spark, sf_dir):
    """Digest of each text without the stop words of its language; as it is if the language has no list."""
    t = F.coalesce("text", F.lit(""))
    out = t
    for code, name in _LISTS.items():
        out = F.when(F.col("lang") == code, text.drop_stop_words(t, text.STOP_WORDS[name])).otherwise(out)
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("digest"))


_LISTS = {code: text.CODES[code] for code in ("en", "de", "fr", "es")}


def detected_languages(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.languages_of(F.coalesce("text", F.lit(""))), ",").alias("languages"))


FILTERS = {"ranges": [{"field": "p_retailprice", "min": 950, "max": 1500}], "terms": [{"field": "p_brand", "values": ["brand#12", "Brand#2", "Brand#17"]}]}


def facet_filters(spark, sf_dir):
    return facets.apply_filters(_read(spark, sf_dir, "part"), FILTERS).select("p_partkey", "p_brand", "p_retailprice")


def facet_sort(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    keys = facets.apply_sort(part, {"field": "p_size", "order": "desc"}, {"field": "p_retailprice", "order": "asc"}, keep_relevance=False)
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(*keys, "p_partkey"))
    return part.select("p_partkey", "p_brand", rank.alias("place")).where("place <= 5")


def bm25(spark, sf_dir):
    """Benchmark items as queries against all documents: the twenty best each."""
    docs, asked = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    got = ranking.rank(docs, asked, text.tokens(F.coalesce("text", F.lit(""))), text.tokens(F.col("text")), "doc_id", "item_id").withColumn("bm25", F.round("bm25", 6))
    order = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bm25"), "doc_id"))
    return got.withColumn("place", order).where("place <= 20")


def corpus_statistics(spark, sf_dir):
    totals, df = ranking.corpus_stats(_read(spark, sf_dir, "documents"), text.tokens(F.coalesce("text", F.lit(""))))
    one = totals.select(F.col("n_docs").cast("long").alias("n_docs"), F.round("mean_length", 6).alias("mean_length"))
    return df.select("term", F.col("df").cast("long").alias("df")).crossJoin(F.broadcast(one))  # one row of totals


def html_source(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.md5(content.html_text(F.col("html"))).alias("digest"))


def json_source(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    ship(spark)
    return part.select("p_partkey", content.json_text(F.to_json(F.struct("p_name", "p_size", F.struct("p_brand", F.array("p_type")).alias("more")))).alias("leaves"))


def base64_source(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select(F.base64(F.encode("p_name", "UTF-8")).alias("content"))
    return content.dictionary_of(part, kind="base64")


def text_source(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    return content.dictionary_of(docs, min_length=3, stop_words=text.STOP_WORDS["english"])


def chunked(spark, sf_dir):
    docs = _read(spark, sf_dir, "conversations")
    return docs.select("conv_id", "turn", F.posexplode(content.chunks(F.coalesce("text", F.lit("")), 200, 0, "sentence")).alias("no", "chunk"))


def wildcards(spark, sf_dir):
    return _names(spark, sf_dir).where(text.matches_wildcard(F.col("word"), F.lit("*e*l*"))).select("word")


def word_boundaries(spark, sf_dir):
    part = _names(spark, sf_dir)
    return part.select("word", text.contains_word(F.col("word"), F.lit("bolt"), True).alias("whole"), text.contains_word(F.col("word"), F.lit("ol")).alias("inside"), text.starts_word(F.col("word"), F.lit("bo")).alias("starts"))


def _phrases(spark, sf_dir) -> DataFrame:
    """A text of each part and a phrase of two words: two neighbours, two with a letter less each, the first and third, or one that is not there."""
    part = _read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    w = F.split("t", " ")
    pairs = (F.concat_ws(" ", w[0], w[1]), F.concat_ws(" ", F.substring(w[0], 2, 99), F.substring(w[1], 2, 99)), F.concat_ws(" ", w[2], w[0]), F.lit("no such"))
    return part.select("p_partkey", "t", F.element_at(F.array(*pairs), (F.col("p_partkey") % 4 + 1).cast("int")).alias("p"))


def phrase_matches(spark, sf_dir):
    found = phrase.phrase_score(F.col("t"), F.col("p"))
    return _phrases(spark, sf_dir).select("p_partkey", F.round(found["score"], 6).alias("score"), found["type"].alias("type"))


def exact_and_prefix(spark, sf_dir):
    """The five shortest part names that begin with each distinct first letters of a name."""
    names = _names(spark, sf_dir).select("word", F.lower("word").alias("lc"))
    heads = names.select(F.substring("lc", 1, 3).alias("head")).distinct()
    pairs = names.withColumn("head", F.substring("lc", 1, 3)).join(heads, "head")
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("head").orderBy(F.length("word"), "word"))).where("place <= 5").select("head", "word", "place")


def phonetic_codes(spark, sf_dir):
    built = _index(spark, sf_dir, languages=["english", "german"])
    return built.phonetic.select("code", "base_id", "lang")


def word_variants(spark, sf_dir):
    """Variants of every part name."""
    built = _index(spark, sf_dir)
    return built.variant.join(index.dealt(built.base.select("base_id", "word")), "base_id").select("variant", "word", "kind", "lang")


def gram_index(spark, sf_dir):
    built = _index(spark, sf_dir)
    return built.ngram.join(index.dealt(built.base), "base_id").select("gram", "word")


def index_sizes(spark, sf_dir):
    return _letters_index(spark, sf_dir).stats()


def _asked(spark, sf_dir) -> DataFrame:
    """Each distinct part name with its third letter dropped."""
    return _names(spark, sf_dir).select(F.xxhash64("word").alias("query_id"), F.concat(F.substring("word", 1, 2), F.expr("substring(word, 4)")).alias("query"))


def search_batch(spark, sf_dir):
    """Every part name, one letter short, against all part names."""
    got = search.search(_letters_index(spark, sf_dir), _asked(spark, sf_dir), limit=3)
    return got.select("query", F.col("rank").cast("int").alias("rank"), "display", "match_type", F.round("score", 6).alias("score"))


def search_first_letters(spark, sf_dir):
    """Beginnings and inner parts of part names as queries: prefixes and substrings."""
    names = _names(spark, sf_dir)
    parts = names.select(F.explode(F.array(F.substring("word", 1, 4), F.substring("word", 3, 4))).alias("query")).where("length(trim(query)) = 4").distinct()
    got = search.search(_letters_index(spark, sf_dir), parts.select(F.xxhash64("query").alias("query_id"), "query"), limit=5, threshold=0.2)
    return got.select("query", F.col("rank").cast("int").alias("rank"), "display", "match_type", F.round("score", 6).alias("score"))


def search_fields(spark, sf_dir):
    """Records with several fields: weights, facets and a custom sort."""
    part = _read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), "p_brand", "p_type")
    built = index.build(part, {"languages": ["english"], "field_weights": {"name": 2.0}, "features": ["partial-words", "missing-letters"]}, fields=["name", "p_brand", "p_type"], ord_col="p_partkey")
    got = search.search(built, ["bolt"], limit=20, filters={"terms": [{"field": "p_brand", "values": ["Brand#2", "Brand#17"]}]}, sort={"primary": {"field": "p_brand", "order": "asc", "type": "string"}}, highlight=True)
    return got.select("query_id", "rank", "display", "field", F.round("score", 6).alias("score"), highlight.as_html(F.col("display"), F.col("highlights")).alias("html"))


def fql_query(spark, sf_dir):
    got = fql(_letters_index(spark, sf_dir), "fql((bolt OR gear) AND NOT small SCORE>0.3)", limit=50)
    return got.select(F.col("rank").cast("int").alias("rank"), "display", F.round("score", 6).alias("score"))


def fql_regex(spark, sf_dir):
    return fql(_index(spark, sf_dir), 'fql(REGEX:"^[a-m].*e")', limit=1 << 30, allow_regex=True).select(F.col("display").alias("word"))


def phrase_query(spark, sf_dir):
    """A phrase, whole, with errors or apart, and a word beside it."""
    got = phrase.phrase_search(_letters_index(spark, sf_dir), ['"blue bolt" gear'], limit=20)
    return got.select(F.col("rank").cast("int").alias("rank"), "display", "match_type", F.round("score", 6).alias("score"))


def index_update(spark, sf_dir):
    """Adding words that are there changes nothing, adding new ones adds them, removing takes them out."""
    built = _index(spark, sf_dir, features=["partial-words"])
    more = _read(spark, sf_dir, "part").select(F.col("p_type").alias("word")).unionByName(_names(spark, sf_dir))
    grown = index.add(built, more)
    less = index.remove(grown, _names(spark, sf_dir))
    return less.base.select("word_lc")


QUERIES = {
    f.__name__: f
    for f in (
        search_slice, fuzzy_join, fuzzy_join_transpositions, normalized, accents, tokenized, gram_jaccard, segmented, without_stop_words, detected_languages, facet_filters, facet_sort, bm25, corpus_statistics,
        html_source, json_source, base64_source, text_source, chunked, wildcards, word_boundaries, phrase_matches, exact_and_prefix, phonetic_codes, word_variants, gram_index, index_sizes, search_batch, search_first_letters,
        search_fields, fql_query, fql_regex, phrase_query, index_update,
    )
}

_SEP = r"[\s\-_.,;:!?()\[\]{}''\"/\\#@$%^&*+=<>|~`]"


def _tokens_sql(n: int) -> str:
    return f"list_filter(string_split_regex(lower(coalesce(text, '')), '{_SEP}+'), lambda x: length(x) >= {n})"


_DISTANCE = "CASE WHEN length(nq) <= 9 THEN 2 ELSE 3 END"
_NATIONS = "SELECT n_nationkey::BIGINT AS query_id, lower(n_name) AS nq FROM nation UNION ALL SELECT (r_regionkey + 1000)::BIGINT, lower(r_name) FROM region"
_SPACED = r"regexp_replace(regexp_replace(lower(coalesce(text, '')), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


def _replaced(sql: str, pairs) -> str:
    quoted = lambda x: x.replace("'", "''")
    for a, b in pairs:
        sql = f"replace({sql}, '{quoted(a)}', '{quoted(b)}')"
    return sql


def _grams(c: str) -> str:
    return f"(CASE WHEN length({c}) < 3 THEN [{c}] ELSE list_distinct(list_transform(range(1, length({c}) - 1), lambda i: {c}[i:i + 2])) END)"


def _listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _letters(name: str) -> str:
    return f"CASE WHEN regexp_matches(coalesce(text, ''), '[{text.LETTERS[name]}]') THEN '{name}' END"


_NAMES = "SELECT DISTINCT p_name AS word FROM part"
_BUDGET = languages.BUDGET["balanced"]


def _ending(e: str) -> str:
    return f"CASE WHEN ends_with(t, '{e}') AND n > {len(e) + 2} THEN t[:n - {len(e)}] END"


def _unended(e: str, least: int) -> str:
    stem = f"CASE WHEN ends_with(t, '{e}') AND n > {least} THEN t[:n - {len(e)}] END"
    return f"{stem}, {stem} || 'e'"


def _matches_sql(threshold: float) -> str:
    """Ranked matches r (qid, query, word, match_type, v, score, rank) of the queries q (qid, query) with all part names."""
    return f"""
m AS (SELECT qid, query, word, lower(word) AS lc, lower(query) AS nq, length(word)::DOUBLE AS n, length(query)::DOUBLE AS l, levenshtein(lower(word), lower(query)) AS d FROM q, ({_NAMES})),
k AS (SELECT *, greatest(n, l) AS high, CASE WHEN lc = nq THEN 'exact' WHEN starts_with(lc, nq) THEN 'prefix' WHEN d <= CASE WHEN l <= 9 THEN 2 ELSE 3 END THEN 'fuzzy' WHEN contains(lc, nq) AND l >= 2 THEN 'substring' END AS match_type FROM m),
s AS (SELECT qid, query, word, match_type, greatest(0.0, least(1.0, CASE match_type WHEN 'exact' THEN 1.0
  WHEN 'prefix' THEN CASE WHEN n - l <= 3 THEN least(1.0, 0.97 * (0.2 + 0.8 * l / n) + 0.08) ELSE 0.97 * (0.2 + 0.8 * l / n) END
  WHEN 'fuzzy' THEN greatest(0.3, 0.7 * (least(l, n) / high) * (1 - 1.5 * d / high)) + CASE WHEN high > 4 THEN 0 WHEN d <= 1 THEN 0.15 WHEN d <= 2 THEN 0.08 ELSE 0 END
  ELSE 0.87 * (0.4 + 0.6 * l / n) - 0.5 * pow((instr(lc, nq) - 1) / n, 3) END)) AS v FROM k WHERE match_type IS NOT NULL),
r AS (SELECT *, round(v, 6)::DOUBLE AS score, (row_number() OVER (PARTITION BY qid ORDER BY v DESC, word))::INTEGER AS rank FROM s WHERE v >= {threshold})"""


ORACLES = {
    "search_slice": f"WITH q AS (SELECT 0 AS qid, '{QUERY}' AS query), {_matches_sql(0.33)} SELECT word, match_type, score FROM r WHERE rank <= 10",
    "search_batch": f"WITH q AS (SELECT word AS qid, word[1:2] || word[4:] AS query FROM ({_NAMES})), {_matches_sql(0.33)} SELECT query, rank, word AS display, match_type, score FROM r WHERE rank <= 3",
    "search_first_letters": f"""
WITH q AS (SELECT DISTINCT query AS qid, query FROM (SELECT unnest([word[1:4], word[3:6]]) AS query FROM ({_NAMES})) WHERE length(trim(query)) = 4), {_matches_sql(0.2)}
SELECT query, rank, word AS display, match_type, score FROM r WHERE rank <= 5""",
    "fql_query": f"""
WITH q AS (SELECT unnest(['bolt', 'gear', 'small']) AS qid, unnest(['bolt', 'gear', 'small']) AS query), {_matches_sql(0.33)},
b AS (SELECT word, max(v) AS v FROM r WHERE qid <> 'small' AND word NOT IN (SELECT word FROM r WHERE qid = 'small' AND v > 0.3) GROUP BY word)
SELECT (row_number() OVER (ORDER BY v DESC, word))::INTEGER AS rank, word AS display, round(v, 6)::DOUBLE AS score FROM b""",
    "index_sizes": f"""
WITH n AS (SELECT DISTINCT lower(p_name) AS lc FROM part)
SELECT name, rows::BIGINT AS rows FROM (VALUES ('base', (SELECT count(*) FROM n)), ('variant', (SELECT count(*) FROM n)), ('phonetic', 0), ('synonym', 0),
  ('ngram', (SELECT sum(len({_grams("lc")})) FROM n WHERE length(lc) > 3))) t(name, rows)""",
    "fuzzy_join": f"""
WITH t AS (SELECT DISTINCT unnest({_tokens_sql(3)}) AS variant FROM (SELECT strip_accents({_replaced("text", text.FOLDS.items())}) AS text FROM documents)), q AS ({_NATIONS})
SELECT query_id, variant, levenshtein(variant, nq)::INTEGER AS edit FROM t, q WHERE levenshtein(variant, nq) <= {_DISTANCE}""",
    "fuzzy_join_transpositions": f"""
WITH t AS (SELECT DISTINCT unnest({_tokens_sql(3)}) AS variant FROM (SELECT strip_accents({_replaced("text", text.FOLDS.items())}) AS text FROM documents)), q AS ({_NATIONS})
SELECT query_id, variant, damerau_levenshtein(variant, nq)::INTEGER AS edit FROM t, q WHERE damerau_levenshtein(variant, nq) <= {_DISTANCE}""",
    "normalized": "SELECT doc_id, " + ", ".join(f"md5({_replaced(_SPACED, languages.REPLACEMENTS[n])}) AS {n}" for n in ("english", "german", "spanish", "french")) + " FROM documents",
    "accents": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, strip_accents({_replaced("coalesce(text, '')", text.FOLDS.items())}) AS plain FROM documents)
SELECT doc_id, md5(plain) AS plain, plain <> text AS marked FROM d""",
    "tokenized": f"""
WITH d AS (SELECT doc_id, {_tokens_sql(1)} AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM d""",
    "gram_jaccard": f"""
WITH p AS (SELECT DISTINCT p_name, lower(p_name) AS a, lower(p_type) AS p_type FROM part), g AS (SELECT *, {_grams('a')} AS x, {_grams('p_type')} AS y FROM p)
SELECT p_name, p_type, round(CASE WHEN a = p_type THEN 1.0 WHEN a = '' OR p_type = '' THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6)::DOUBLE AS jaccard,
  least(levenshtein(a, p_type), 6)::INTEGER AS distance FROM g""",
    "segmented": r"""
SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z]', '', 'g') AS alpha, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, regexp_matches(c_name, '[A-Za-z]') AND regexp_matches(c_name, '[0-9]') AS mixed,
  array_to_string(regexp_extract_all(c_name, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+'), '|') AS segments FROM customer""",
    "without_stop_words": rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '' AND NOT list_contains(CASE lang {" ".join(f"WHEN '{c}' THEN [{_listed(text.STOP_WORDS[n])}]" for c, n in _LISTS.items())} ELSE [] END, lower(x))) AS t FROM documents)
SELECT doc_id, md5(CASE WHEN len(t) > 0 AND lang IN ({_listed(list(_LISTS))}) THEN array_to_string(t, ' ') ELSE text END) AS digest FROM d""",
    "detected_languages": f"SELECT doc_id, array_to_string(list_filter(['english', {', '.join(map(_letters, text.LETTERS))}], lambda x: x IS NOT NULL), ',') AS languages FROM documents",
    "facet_filters": "SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_retailprice BETWEEN 950 AND 1500 AND lower(p_brand) IN ('brand#12', 'brand#2', 'brand#17')",
    "facet_sort": "SELECT p_partkey, p_brand, place FROM (SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_partkey))::INTEGER AS place FROM part) WHERE place <= 5",
    "bm25": f"""
WITH d AS (SELECT doc_id, {_tokens_sql(1)} AS t FROM documents), n AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_tokens_sql(1)}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, length, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5) + 1), 0.1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS bm25 FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY ALL)
SELECT item_id, doc_id, bm25, place FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id))::INTEGER AS place FROM s) WHERE place <= 20""",
    "corpus_statistics": f"""
WITH d AS (SELECT doc_id, {_tokens_sql(1)} AS t FROM documents), n AS (SELECT count(*)::BIGINT AS n_docs, round(avg(len(t)), 6)::DOUBLE AS mean_length FROM d)
SELECT term, count(*)::BIGINT AS df, any_value(n_docs) AS n_docs, any_value(mean_length) AS mean_length FROM (SELECT doc_id, unnest(list_distinct(t)) AS term FROM d), n GROUP BY term""",
    "html_source": r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'g') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(""" + _replaced("t", content.ENTITIES) + r""", '\s+', ' ', 'g'))) AS digest FROM a""",
    "json_source": "SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS leaves FROM part",
    "base64_source": f"SELECT DISTINCT unnest(list_filter(string_split_regex(lower(p_name), '{_SEP}+'), lambda x: length(x) >= 1)) AS word FROM part",
    "text_source": f"SELECT word FROM (SELECT DISTINCT unnest({_tokens_sql(3)}) AS word FROM documents) WHERE word NOT IN ({_listed(text.STOP_WORDS['english'])})",
    "chunked": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, conv_id, turn, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM conversations),
s AS (SELECT id, 1 AS i, 0 AS no, length(parts[1]) AS held FROM d WHERE len(parts) > 0
  UNION ALL SELECT id, i + 1, CASE WHEN held + 1 + length(parts[i + 1]) > 200 THEN no + 1 ELSE no END, CASE WHEN held + 1 + length(parts[i + 1]) > 200 THEN 0 ELSE held + 1 END + length(parts[i + 1]) FROM s JOIN d USING (id) WHERE i < len(parts))
SELECT any_value(conv_id) AS conv_id, any_value(turn) AS turn, no::INTEGER AS no, string_agg(parts[i], ' ' ORDER BY i) AS chunk FROM s JOIN d USING (id) GROUP BY id, no""",
    "word_variants": f"""
WITH w AS (SELECT word, lower(word) AS t, length(word) AS n FROM ({_NAMES})),
a AS (SELECT *, CASE WHEN n <= 6 THEN {_BUDGET[0]} WHEN n <= 12 THEN {_BUDGET[1]} ELSE {_BUDGET[2]} END AS most, [t, {", ".join(map(_ending, languages.ENDINGS["english"].split()))}] AS stems FROM w),
b AS (SELECT *, CASE WHEN n > 4 THEN list_transform(range(3, n, greatest(1, (n - 3) // most)), lambda k: t[:k]) ELSE [] END AS heads FROM a),
c AS (SELECT *, coalesce(list_filter(range(1, len(heads) + 1), lambda j: len(list_distinct(list_concat(stems, [word], heads[:j]))) - 2 >= most)[1], len(heads)) AS last FROM b),
v AS (SELECT word, t, list_distinct(list_concat(stems, heads[:last], [CASE WHEN NOT ends_with(t, 's') THEN t || 's' WHEN n > 3 THEN t[:n - 1] END, {_unended("ing", 5)}, {_unended("ed", 4)}])) AS variants FROM c)
SELECT variant, word, CASE WHEN variant = t THEN 'normal' ELSE 'partial' END AS kind, 'english' AS lang FROM (SELECT word, t, unnest(variants) AS variant FROM v) WHERE variant <> ''""",
    "wildcards": f"SELECT word FROM ({_NAMES}) WHERE regexp_matches(lower(word), '^.*e.*l.*$')",
    "word_boundaries": rf"SELECT word, regexp_matches(lower(word), '(^|{_SEP})bolt({_SEP}|$)') AS whole, contains(lower(word), 'ol') AS inside, regexp_matches(lower(word), '(^|[^a-z0-9_])bo') AS starts FROM ({_NAMES})",
    "phrase_matches": """
WITH a AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS t FROM part), b AS (SELECT *, string_split(t, ' ') AS w FROM a),
c AS (SELECT p_partkey, lower(t) AS t, string_split(lower(t), ' ') AS w, string_split(lower([w[1] || ' ' || w[2], w[1][2:] || ' ' || w[2][2:], w[3] || ' ' || w[1], 'no such'][p_partkey % 4 + 1]), ' ') AS p FROM b),
e AS (SELECT *, list_transform(range(1, len(w)), lambda i: [levenshtein(w[i], p[1]), levenshtein(w[i + 1], p[2])]) AS d, abs(list_position(w, p[1]) - list_position(w, p[2])) AS span FROM c),
f AS (SELECT *, list_filter(d, lambda x: x[1] <= 1 AND x[2] <= 1)[1] AS near FROM e)
SELECT p_partkey, round(CASE WHEN contains(t, p[1] || ' ' || p[2]) THEN 1.0 WHEN near IS NOT NULL THEN 0.7 + 0.2 * (1 - (near[1] + near[2]) / 2.0) WHEN span <= 6 THEN 0.5 + 0.2 * (1 - span / 6.0) ELSE 0.0 END, 6)::DOUBLE AS score,
  CASE WHEN contains(t, p[1] || ' ' || p[2]) THEN 'exact' WHEN near IS NOT NULL THEN 'fuzzy' WHEN span <= 6 THEN 'proximity' ELSE 'none' END AS type FROM f""",
    "exact_and_prefix": f"SELECT head, word, place FROM (SELECT lower(word)[1:3] AS head, word, (row_number() OVER (PARTITION BY lower(word)[1:3] ORDER BY length(word), word))::INTEGER AS place FROM ({_NAMES})) WHERE place <= 5",
    "gram_index": f"SELECT DISTINCT unnest({_grams('lc')}) AS gram, word FROM (SELECT word, lower(word) AS lc FROM ({_NAMES})) WHERE length(lc) > 3",
    "phrase_query": f"""
WITH q AS (SELECT 0 AS qid, 'gear' AS query), {_matches_sql(0.33)},
a AS (SELECT word, lower(word) AS t, string_split(lower(word), ' ') AS w FROM ({_NAMES})),
e AS (SELECT *, list_filter(list_transform(range(1, len(w)), lambda i: [levenshtein(w[i], 'blue'), levenshtein(w[i + 1], 'bolt')]), lambda x: x[1] <= 1 AND x[2] <= 1)[1] AS near, abs(list_position(w, 'blue') - list_position(w, 'bolt')) AS span FROM a),
f AS (SELECT word, least(1.0, 1.5 * CASE WHEN contains(t, 'blue bolt') THEN 1.0 WHEN near IS NOT NULL THEN 0.7 + 0.2 * (1 - (near[1] + near[2]) / 2.0) WHEN span <= 6 THEN 0.5 + 0.2 * (1 - span / 6.0) END) AS p FROM e WHERE contains(t, 'blue bolt') OR near IS NOT NULL OR span <= 6),
b AS (SELECT word, CASE WHEN v IS NULL THEN p WHEN p IS NULL THEN 0.8 * v ELSE least(1.0, 1.2 * p) END AS x, CASE WHEN v IS NULL THEN 'phrase' WHEN p IS NULL THEN 'term' ELSE 'phrase_term' END AS match_type FROM f FULL JOIN r USING (word))
SELECT rank, display, match_type, score FROM (SELECT (row_number() OVER (ORDER BY x DESC, word))::INTEGER AS rank, word AS display, match_type, round(x, 6)::DOUBLE AS score FROM b WHERE x >= 0.33) WHERE rank <= 20""",
    "fql_regex": f"SELECT word FROM ({_NAMES}) WHERE regexp_matches(word, '^[a-m].*e')",
    "index_update": "SELECT DISTINCT lower(p_type) AS word_lc FROM part WHERE lower(p_type) NOT IN (SELECT lower(p_name) FROM part)",
}
