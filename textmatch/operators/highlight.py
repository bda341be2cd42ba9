"""Where a result matches its query, and the result as HTML with marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ngrams

_SPANS = "array<struct<start:int,end:int,type:string>>"


def _span(start: Column, end: Column, type_: Column) -> Column:
    return F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), type_.alias("type")))


def _merged(spans: Column) -> Column:
    """Spans of one type in order, touching ones joined."""

    def step(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        joined = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["type"].alias("type"))))
        return F.when((F.size(a) > 0) & (x["start"] <= last["end"]), joined).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.sort_array(spans), F.array().cast(_SPANS), step)


def highlights(word: Column, query: Column, type_: Column) -> Column:
    """Array of start, end, type: the whole word for exact, phonetic, synonym and compound; the beginning for prefix; the place for
    substring; the letters that follow the query in order for fuzzy; all shared grams for n-grams."""
    w, q = F.lower(word), F.lower(query)
    one = lambda at, n: F.struct(at.cast("int").alias("start"), (at + n).cast("int").alias("end"), type_.alias("type"))
    start = F.struct(F.lit(1).alias("k"), F.array().cast(_SPANS).alias("out"))
    letters = F.transform(F.split(w, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    follow = lambda a, x: F.when(F.substring(q, a["k"], F.lit(1)) == x["c"], F.struct((a["k"] + 1).alias("k"), F.concat(a["out"], F.array(one(x["i"], F.lit(1)))).alias("out"))).otherwise(a)
    subsequence = F.aggregate(letters, start, follow, lambda a: a["out"])
    grams = F.transform(ngrams(w, 3), lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    shared = F.transform(F.filter(grams, lambda g: F.array_contains(ngrams(q, 3), g["g"])), lambda g: one(g["i"], F.length(g["g"])))
    at = F.call_function("locate", q, w) - 1
    out = (
        F.when(type_.isin("exact", "phonetic", "synonym", "compound"), _span(F.lit(0), F.length(word), type_))
        .when(type_ == "prefix", _span(F.lit(0), F.length(query), type_))
        .when(type_ == "substring", F.when(at >= 0, _span(at, at + F.length(query), type_)))
        .when(type_ == "fuzzy", _merged(subsequence))
        .when(type_ == "ngram", _merged(shared))
    )
    return F.coalesce(out, F.array().cast(_SPANS))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def as_html(word: Column, spans: Column, tag: str = "mark", class_name: str | None = None) -> Column:
    """word with each span in a tag that carries its type."""
    named = lambda t: F.concat(F.lit(f' class="{class_name} {class_name}--'), t, F.lit('"')) if class_name else F.lit("")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: escaped(F.substring(word, a + 1, b - a))
    step = lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["out"], piece(a["at"], x["start"]), F.lit(f"<{tag}"), named(x["type"]), F.lit(' data-type="'), x["type"], F.lit('">'), piece(x["start"], x["end"]), F.lit(f"</{tag}>")).alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], piece(a["at"], F.length(word))))
