"""Columns that turn contents into text, chunks and distinct words."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..runtime import active

#: References that are decoded, in order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))


def html_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; white space as one space."""
    for pattern in (r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>"):
        html = F.regexp_replace(html, pattern, " ")
    for a, b in ENTITIES:
        html = F.replace(html, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(html, r"\s+", " "))


def json_strings(text: str | None, depth: int = 10) -> str:
    """String leaves of a JSON text down to a depth, joined by spaces; empty if it is no JSON."""

    def walk(x, level: int) -> list[str]:
        if level > depth:
            return []
        if isinstance(x, str):
            return [x]
        items = x.values() if isinstance(x, dict) else x if isinstance(x, list) else []
        return [s for i in items for s in walk(i, level + 1)]

    try:
        return " ".join(walk(json.loads(text), 0)) if text else ""
    except ValueError:
        return ""


def json_text(text: Column, depth: int = 10) -> Column:
    active()

    @F.pandas_udf("string")
    def run(texts):
        from textmatch.sources.content import json_strings

        return texts.map(lambda t: json_strings(t, depth))

    return run(text)


def base64_text(text: Column) -> Column:
    """Latin-1 text of base64; null if it is none."""
    return F.decode(F.try_to_binary(text, F.lit("base64")), "ISO-8859-1")


def chunks(text: Column, size: int = 1000, overlap: int = 0, unit: str = "word") -> Column:
    """Pieces of about size characters made of whole words, sentences or paragraphs. overlap (words only) repeats the last overlap / 10 words."""
    pattern, joint = {"word": (r"\s+", " "), "sentence": (r"(?<=[.!?])\s+", " "), "paragraph": (r"\n\s*\n", "\n\n")}[unit]
    parts = F.filter(F.split(text, pattern), lambda x: x != "")
    back = -(-overlap // 10) if unit == "word" else 0
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"))
    length = lambda a: F.length(F.array_join(a, joint))

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["open"]) > 0) & (length(a["open"]) + len(joint) + F.length(x) > size)
        keep = F.slice(a["open"], F.greatest(F.size(a["open"]) - back + 1, F.lit(1)), F.lit(back)) if back else F.array().cast("array<string>")
        return F.when(full, F.struct(F.concat(a["done"], F.array(F.array_join(a["open"], joint))).alias("done"), F.concat(keep, F.array(x)).alias("open"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["open"], F.array(x)).alias("open")))

    return F.aggregate(parts, start, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], joint)))).otherwise(a["done"]))


def dictionary_of(df: DataFrame, content: str = "content", kind: str = "text", min_length: int = 1, stop_words: list[str] | None = None, distinct: bool = True) -> DataFrame:
    """word rows of a column of text, html, json or base64 contents."""
    c = F.col(content)
    text = {"text": lambda: c, "html": lambda: html_text(c), "json": lambda: json_text(c), "base64": lambda: base64_text(c)}[kind]()
    words = df.select(F.explode(tokens(text, min_length)).alias("word"))
    if stop_words:
        words = words.where(~F.col("word").isin([w.lower() for w in stop_words]))
    return words.distinct() if distinct else words


def fetch(spark, urls: list[str], timeout: float = 10.0) -> DataFrame:
    """url, content; content is null where nothing came. The driver fetches."""
    from http.client import HTTPException
    from urllib.request import urlopen

    rows = []
    for url in urls:
        try:
            with urlopen(url, timeout=timeout) as r:  # noqa: S310
                rows.append((url, r.read().decode("utf-8", "replace")))
        except (OSError, ValueError, HTTPException):  # unreachable, malformed, or no HTTP
            rows.append((url, None))
    return spark.createDataFrame(rows, "url string, content string")
