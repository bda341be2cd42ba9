import pytest
from pyspark.sql import functions as F

from textmatch.functions import distance, facets, ranking, text
from textmatch.operators import highlight, phrase
from textmatch.sources import content


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_text(spark):
    lit = F.lit
    got = one(
        spark, text.ngrams(lit("hello")), text.ngrams(lit("hi")), text.remove_accents(lit("Crème brûlée Øl ß Ǻ")), text.tokens(lit("Hello, big-world!")), text.segments(lit("api_manager_3254")), text.alpha_part(lit("test123abc456")),
        text.numeric_part(lit("test123abc456")), text.languages_of(lit("Müller café niño hello")), text.matches_wildcard(lit("application"), lit("app*on")), text.contains_word(lit("new york"), lit("york"), True),
        text.contains_word(lit("newyork"), lit("york"), True), text.drop_stop_words(lit("the big house"), ["the"]), text.drop_stop_words(lit("the"), ["the"]), text.language_code(lit("DE")), text.has_accents(lit("abc")),
        text.starts_word(lit("écat"), lit("cat")), text.token_positions(lit("ab, c")),
    )
    assert got[:9] == [["hel", "ell", "llo"], ["hi"], "Creme brulee Ol ss A", ["hello", "big", "world"], ["api", "_", "manager", "_", "3254"], "testabc", "123456", ["english", "german", "french", "spanish"], True]
    assert got[9:16] == [True, False, "big house", "the", "german", False, True]
    assert [tuple(x) for x in got[16]] == [("ab", 0, 2), ("c", 4, 5)]


def test_distance(spark):
    lit = F.lit
    got = one(spark, distance.levenshtein(lit("abcdef"), lit("x"), 2), distance.jaccard(lit("abc"), lit("abc")), distance.jaccard(lit("abcd"), lit("bcde")), distance.similarity(lit(5), lit(10)), distance.similarity(lit(0), lit(0)),
              distance.are_similar(lit("application"), lit("aplication")), distance.alphanumeric_score(lit("daqamanager3561"), lit("datamanager3561"), 2), distance.damerau_levenshtein(lit("teh"), lit("the")), distance.compare_segments(lit("ab12"), lit("ab12")))
    assert got[:6] == [3, 1.0, pytest.approx(1 / 3), 0.5, 1.0, True]
    assert got[6] == pytest.approx(0.93636, abs=1e-5) and got[7:] == [1, 1.0]


def test_ranking(spark):
    got = one(spark, ranking.idf(F.lit(10), F.lit(3)), ranking.squashed(F.lit(0.0)), ranking.squashed(F.lit(5.0)), ranking.combined(F.lit(0.8), F.lit(0.6)), ranking.idf(F.lit(10), F.lit(0)))
    assert got == pytest.approx([1.145132, 0.047426, 0.5, 0.72, 0.1], abs=1e-6)
    docs = spark.createDataFrame([(1, "search engine optimization"), (2, "search search search"), (3, "database query")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "search")], "query_id long, text string")
    rows = ranking.rank(docs, asked, F.split("text", " "), F.split("text", " ")).orderBy(F.desc("bm25")).collect()
    assert [r["doc_id"] for r in rows] == [2, 1]


@pytest.mark.parametrize("sent", [True, False])
def test_ranking_never_shuffles_pairs(spark, monkeypatch, sent):
    """Pairs of queries and documents are made and added up where the document is, so many a task; the scores are those of the formula, also for repeated ids."""
    import math
    import re
    from collections import Counter

    if not sent:
        monkeypatch.setattr(ranking, "SENT", 0)
    held = [(k % 50, " ".join(f"w{(k * j) % 17}" for j in range(k % 9))) for k in range(60)] + [(None, "w1 w2"), (7, None)]
    asked = [(q, f"w{q} w1 w{q * 3 % 17} w1") for q in range(12)]
    t = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(t, " "), lambda x: x != "")
    args = spark.createDataFrame(held, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string"), words, F.split("text", " ")
    got = ranking.rank(*args)
    plan = got._jdf.queryExecution().executedPlan().treeString()
    assert not sent or not re.search(r"hashpartitioning\(query_id#\d+L, doc_id#", plan)
    n, mean = len(held), sum(len((x or "").split()) for _, x in held) / len(held)
    tf = Counter((d, len((x or "").split()), w) for d, x in held for w in (x or "").split())
    df, expected = Counter(w for _, _, w in tf), Counter()
    for q, x in asked:
        for w in x.split():
            for (d, size, v), k in tf.items():
                if v == w:
                    expected[q, d] += max(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1), 0.1) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * size / mean))
    rows = lambda df: {(r["query_id"], r["doc_id"]): r["bm25"] for r in df.collect()}
    assert rows(got) == pytest.approx(dict(expected)) and rows(ranking.rank(*args, task_pairs=5)) == pytest.approx(dict(expected))
    tasks = ranking.rank(*args, task_pairs=5)._jdf.queryExecution().executedPlan().treeString()
    assert re.search(rf"hashpartitioning\(doc_id#\d+L, {-(-n * 12 // 5)}\)", tasks)  # more documents, more tasks


def test_facets(spark):
    df = spark.createDataFrame([("Cheap", "20", "true", "2024-01-02"), ("Mid", "50", "false", "01/03/2023"), ("Dear", "150", "1", None), ("None", None, None, "x")], "name string, price string, stock string, day string")
    names = lambda d: [r["name"] for r in d.collect()]
    assert names(facets.apply_filters(df, {"ranges": [{"field": "price", "min": 40, "max": 100}]})) == ["Mid", "None"]
    assert names(facets.apply_filters(df, {"booleans": [{"field": "stock", "value": True}]})) == ["Cheap", "Dear", "None"]
    assert names(facets.apply_filters(df, {"terms": [{"field": "price", "values": [20, "150"]}]})) == ["Cheap", "Dear", "None"]
    tagged = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"])], "name string, tags array<string>")
    assert names(facets.apply_filters(tagged, {"terms": [{"field": "tags", "values": ["x", "y"], "operator": "AND"}]})) == ["a"]
    assert names(df.orderBy(*facets.apply_sort(df, {"field": "price", "order": "desc"}))) == ["Dear", "Mid", "Cheap", "None"]
    assert facets.kind_of(df, "price") == "number" and facets.kind_of(df, "name") == "string" and facets.kind_of(df, "day") == "date"


def test_phrase_score(spark):
    score = lambda t, p, swap=False: tuple(one(spark, phrase.phrase_score(F.lit(t), F.lit(p), 1, 2, swap))[0])
    assert score("new york city", "new york") == (1.0, "exact")
    assert score("new yrok city", "new york", True) == (pytest.approx(0.8), "fuzzy")
    assert score("new and york", "new york") == (pytest.approx(0.5), "proximity")
    assert score("hello world", "goodbye") == (0.0, "none")


def test_highlights(spark):
    spans = lambda w, q, t: [tuple(x) for x in one(spark, highlight.highlights(F.lit(w), F.lit(q), F.lit(t)))[0]]
    assert spans("Apple", "app", "prefix") == [(0, 3, "prefix")]
    assert spans("suffixmatch", "match", "substring") == [(6, 11, "substring")]
    assert spans("Application", "aplcn", "fuzzy") == [(0, 2, "fuzzy"), (3, 4, "fuzzy"), (5, 6, "fuzzy"), (10, 11, "fuzzy")]
    html = one(spark, highlight.as_html(F.lit("a<b"), highlight.highlights(F.lit("a<b"), F.lit("a"), F.lit("prefix")), "mark", "hit"))[0]
    assert html == '<mark class="hit hit--prefix" data-type="prefix">a</mark>&lt;b'


def test_sources(spark):
    html = "<html><style>p{}</style><script>x()</script><!-- c --><p>Hello &amp; <b>you</b></p></html>"
    got = one(spark, content.html_text(F.lit(html)), content.base64_text(F.lit("SGVsbG8gV29ybGQ=")), content.base64_text(F.lit("!!")), content.chunks(F.lit("aa bb cc dd"), 5), content.chunks(F.lit("aa bb cc"), 5, 10))
    assert got == ["Hello & you", "Hello World", None, ["aa bb", "cc dd"], ["aa bb", "bb cc"]]
    df = spark.createDataFrame([("Hello world! Hello again.",)], "content string")
    assert {r["word"] for r in content.dictionary_of(df).collect()} == {"hello", "world", "again"}
