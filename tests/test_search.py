"""End to end over one small index; queries go in batches, as a batch is one plan."""

import pytest

from textmatch.functions.distance import damerau
from textmatch.fql.compile import fql
from textmatch.operators import index, match, phrase, search

WORDS = ["Krankenhaus", "Pflegeheim", "Schule", "Hospital", "Doctor", "receive", "receiver", "datamanager3561", "New York City", "New York", "York University", "apple", "suffixmatch"]


def frame(spark, words):
    return spark.createDataFrame(list(enumerate(words)), "ord long, word string")


@pytest.fixture(scope="module")
def built(spark):
    return index.build(frame(spark, WORDS), {"languages": ["english", "german"], "features": ["phonetic", "synonyms", "compound", "partial-words", "transpositions"]}, ord_col="ord").cache()


@pytest.fixture(scope="module")
def found(built):
    rows = search.search(built, ["SCHULE", "krankenh", "physician", "recieve", "daqamanager3561", "New Yor", "match", "hos*", "zzzzqqqq"], limit=5, highlight=True).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["query"], []).append(r)
    return out


def test_matches(found):
    top = {q: (rows[0]["display"], rows[0]["match_type"], round(rows[0]["score"], 5)) for q, rows in found.items()}
    assert top["SCHULE"] == ("Schule", "exact", 1.0)
    assert top["krankenh"][:2] == ("Krankenhaus", "prefix")
    assert top["physician"][:2] == ("Doctor", "synonym")
    assert top["recieve"][0] == "receive"
    assert top["daqamanager3561"] == ("datamanager3561", "fuzzy", 0.93636)
    assert top["New Yor"] == ("New York City", "exact", 1.0)  # a kept prefix of the longer name
    assert next(r for r in found["New Yor"] if r["display"] == "New York")["score"] == pytest.approx(0.953)
    assert top["match"][:2] == ("suffixmatch", "substring")
    assert top["hos*"] == ("Hospital", "exact", 1.0)
    assert "zzzzqqqq" not in found


def test_scores_and_ranks(found):
    for rows in found.values():
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
        assert len({r["display"] for r in rows}) == len(rows)


def test_update_and_remove(spark, built):
    grown = index.add(built, frame(spark, ["apple", "Zebra"]), ord_col="ord")
    assert {r["word"] for r in grown.base.collect()} == {*WORDS, "Zebra"}
    assert grown.variant.where("variant = 'zebra'").count() == 1
    less = index.remove(grown, frame(spark, ["zebra", "APPLE"]))
    assert {r["word"] for r in less.base.collect()} == set(WORDS) - {"apple"}
    assert less.variant.where("variant = 'apple'").isEmpty()


@pytest.mark.parametrize(("language", "edge"), [("english", False), ("german", False), ("english", True)])
def test_few_and_many_queries_have_the_same_candidates(spark, built, language, edge):
    from textmatch import languages

    asked = spark.createDataFrame(list(enumerate(["krank", "ceive", "York", "aple", "heim", "x", "recieve", "Schuel", "new york", "*york", "h*l", "or"])), "query_id long, query string")
    found = lambda few: match.candidates(asked, built, languages.REGISTRY[language], 0, edge, few=few).collect()
    key = lambda rows: sorted((r["query_id"], r["base_id"], r["step"], r["type"], r["variant"] or "", -1 if r["edit_distance"] is None else r["edit_distance"]) for r in rows)
    assert key(found(True)) == key(found(False))


def test_matchers_that_cannot_reach_the_threshold_are_left_out(built):
    full = {(r["query_id"], r["base_id"]): r for r in search.search(built, ["recieve", "doktor", "physician"], limit=50, threshold=0.01).collect()}
    some = {(r["query_id"], r["base_id"]): r for r in search.search(built, ["recieve", "doktor", "physician"], limit=50).collect()}
    assert {k: (r["score"], r["match_type"]) for k, r in full.items() if r["score"] >= 0.33} == {k: (r["score"], r["match_type"]) for k, r in some.items()}


def test_save_and_load(spark, built, tmp_path):
    index.save(built, str(tmp_path / "ix"))
    held = index.load(spark, str(tmp_path / "ix"))
    assert held.config == built.config and held.variant.count() == built.variant.count()
    assert index.load(spark, str(tmp_path / "none")) is None


def test_fql(built):
    names = lambda q, **o: {r["display"] for r in fql(built, q, limit=50, **o).collect()}
    assert names('fql(REGEX:"^[a-d]")', allow_regex=True) == {"datamanager3561", "apple"}
    got = names("fql((schule OR apple) AND NOT apple)")
    assert "Schule" in got and "apple" not in got
    with pytest.raises(ValueError):
        names('REGEX:"x"')


def test_phrases(built):
    rows = phrase.phrase_search(built, ['"new york" city'], limit=5).orderBy("rank").collect()
    assert rows[0]["display"] == "New York City" and rows[0]["score"] == 1.0


def test_phrases_in_blocks(spark, monkeypatch):
    built = index.build(spark.createDataFrame([("New York",), ("York New",), ("Los Angeles",), ("Boston",)], "word string"), {"languages": ["english"]})
    asked = ['"new york" "los angeles"', '"angeles los"', '"no such"']
    rows = lambda: sorted(map(tuple, phrase.phrase_search(built, asked).select("query", "display", "match_type", "score").collect()))
    whole = rows()
    assert {r[1] for r in whole} == {"New York", "York New", "Los Angeles"}
    monkeypatch.setattr(phrase, "BLOCK", 1)
    assert rows() == whole


@pytest.mark.parametrize(("swap", "few"), [(False, False), (True, False), (True, True)])
def test_fuzzy_pairs_lose_nothing(spark, swap, few):
    words = ["a", "ab", "abc", "abcd", "teh", "the", "then", "banana", "bandana", "bnadana", "function", "funciton", "functional", "receive", "recieve", "responsibility", "responsibilty", "irresponsible"]
    df = spark.createDataFrame([(w, len(w)) for w in words], "variant string, len int")
    asked = spark.createDataFrame(list(enumerate(words)), "query_id long, nq string")
    got = {(r["query_id"], r["variant"]): r["edit"] for r in match.fuzzy_pairs(asked, df, 2, swap, few).collect()}

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, x, b, i)
        return row[-1]

    def _next(row, x, b, i):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    d = damerau if swap else plain
    expected = {(k, v): e for k, q in enumerate(words) for v in words if (e := d(v, q)) <= (2 if len(q) <= 9 else 3)}
    assert got == expected


def test_fields(spark):
    rows = [(0, "Apple Pie", "dessert"), (1, "Fruit Salad", "apple based"), (2, "Bread", "plain")]
    df = spark.createDataFrame(rows, "ord long, title string, description string")
    built = index.build(df, {"languages": ["english"], "features": ["partial-words"], "field_weights": {"title": 2.0, "description": 0.5}}, fields=["title", "description"], ord_col="ord")
    got = search.search(built, "apple", threshold=0.1).orderBy("rank").collect()
    assert [r["display"] for r in got][:2] == ["Apple Pie", "Fruit Salad"] and got[0]["score"] > got[1]["score"]
    assert got[0]["field"] == "title" and got[0]["fields"]["description"] == "dessert"


def test_cache():
    cache = search.Cache(2)
    cache.put("a", 1), cache.put("b", 2)
    assert cache.get("a") == 1
    cache.put("c", 3)
    assert cache.get("b") is None and cache.stats()["size"] == 2 and cache.stats()["hits"] == 1


def test_batch_keeps_queries_without_results(spark, built):
    rows = {r["query"]: r["results"] for r in search.batch(built, ["Schule", "Schule", "zzzzqqqq"]).collect()}
    assert rows["zzzzqqqq"] == [] and rows["Schule"][0]["display"] == "Schule" and len(rows) == 2


def test_empty_dictionary(spark):
    built = index.build(frame(spark, ["", "  "]), {"languages": ["english"], "features": ["partial-words"]}, ord_col="ord")
    assert built.base.count() == 0 and built.stats().where("rows > 0").isEmpty()


@pytest.mark.parametrize("n", [1, 40])
def test_index_tables_are_never_sent_whole(spark, n):
    """However small the file looks that they come from: only the queries are broadcast."""
    words = spark.range(200).selectExpr("id AS ord", "concat('bolt ', id) AS word")  # the only Range of the plan
    ix = index.build(words, {"languages": ["english"]}, ord_col="ord")
    got = search.search(ix, [f"bolt {k}" for k in range(n)], limit=3, threshold=0.1)
    lines = got._jdf.queryExecution().executedPlan().treeString().split("\n")
    depth = [min((line.find(x) for x in ("+- ", ":- ") if x in line), default=0) for line in lines]
    sent = 0
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            sent += 1
            inside = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            assert not any("Range (" in x for x in lines[k:inside]), line
    assert sent and any("Range (" in x for x in lines)
    assert {r["display"] for r in got.where("query_id = 0 AND rank = 1").collect()} == {"bolt 0"}
