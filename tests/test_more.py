from pyspark.sql import functions as F

from textmatch import streaming
from textmatch.functions import bloom, text
from textmatch.operators import index


def test_bloom(spark):
    assert bloom.shape(10_000, 0.01) == (95_851, 7)
    words = spark.range(1000).select(F.concat(F.lit("word"), "id").alias("w"))
    made = bloom.Bloom.from_json(bloom.Bloom.of(words, "w").to_json())
    assert words.where(~made.might_contain(F.col("w"))).count() == 0
    others = spark.range(1000).select(F.concat(F.lit("none"), "id").alias("w"))
    assert others.where(made.might_contain(F.col("w"))).count() < 50
    assert 0 < made.stats()["false_positive_rate"] < 0.05


def test_boundary_matches(spark):
    got = spark.range(1).select(text.boundary_matches(F.lit("cat concat cat-cat"), F.lit("cat")).alias("m")).first()["m"]
    assert got == [0, 11, 15]


def test_streams_of_words(spark, tmp_path):
    config = {"languages": ["english"], "features": ["partial-words"]}
    built = index.build(spark.createDataFrame([(0, "apple")], "ord long, word string"), config, ord_col="ord")
    path, source = str(tmp_path / "index"), tmp_path / "in"
    streaming.publish(built, path)
    spark.createDataFrame([("banana",), ("Apple",)], "word string").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("word string").json(str(source))
    query = streaming.keep_indexed(stream, path, str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert {r["word"] for r in streaming.current(spark, path).base.collect()} == {"apple", "banana"}
    assert built.mode() == "classic"


def test_a_batch_that_is_replayed_is_added_once(spark, tmp_path):
    path = str(tmp_path / "index")
    words = lambda *ws: spark.createDataFrame([(w,) for w in ws], "word string")
    streaming.publish(index.build(words("apple"), {"languages": ["english"], "features": ["partial-words"]}), path)
    now = lambda: sorted(r["word"] for r in streaming.current(spark, path).base.collect())
    streaming.add_batch(words("banana", "Apple"), path, 0)
    streaming.add_batch(words("cherry"), path, 1)
    for number, batch in ((1, words("cherry")), (0, words("banana", "Apple"))):
        streaming.add_batch(batch, path, number)
        assert now() == ["apple", "banana", "cherry"]
    streaming.compact(spark, path)
    streaming.add_batch(words("cherry"), path, 1)
    streaming.add_batch(words("date"), path, 2)
    assert now() == ["apple", "banana", "cherry", "date"]


def test_ids_do_not_depend_on_partitions(spark):
    words = spark.createDataFrame([(f"word{k}",) for k in range(200)], "word string")
    ids = lambda df: {r["word"]: r["base_id"] for r in index.build(df, {"languages": ["english"], "features": []}).base.collect()}
    assert ids(words.repartition(7)) == ids(words.coalesce(1))


def test_progress_normalizer_and_helpers(spark):
    import textmatch
    from textmatch.operators import search
    from textmatch.sources import content

    seen, words = [], spark.createDataFrame([("Anna-Lena",), ("Bert",)], "word string")
    built = index.build(words, {"languages": ["english"], "features": [], "custom_normalizer": lambda w: w.replace("-", "")}, progress=lambda *x: seen.append(x))
    assert seen == [(t, k, 5) for k, t in enumerate(index.TABLES, 1)] and built.variant.where("variant = 'annalena'").count() == 1
    assert [r["display"] for r in search.search(built, "anna-lena").collect()] == ["Anna-Lena"]
    got = spark.range(1).select(text.normalize_for_search(F.lit("Big-World, here!")), text.join_tokens(F.array(F.lit("a"), F.lit("b")), "+"), text.split_phrase_words(F.lit(" New  York "))).first()
    assert list(got) == ["big world here", "a+b", ["new", "york"]] and textmatch.VERSION
    assert [r["content"] for r in content.fetch(spark, ["no url", "http://", "http://127.0.0.1:1/x", "http://[bad/"]).collect()] == [None] * 4
