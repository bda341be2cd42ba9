"""Scores of matches as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.distance import alphanumeric_score, jaccard
from ..functions.text import is_alphanumeric


def score(config: dict, type_: Column, query: Column, word: Column, variant: Column, edit: Column, normalized: Column, strict: bool = False) -> Column:
    """Between 0 and 1. strict compares the query with itself for n-grams, as older results did."""
    s, mod, an = config["scores"], config["modifiers"], config["alphanumeric"]
    q, w = F.length(query), F.length(word)
    low, high = F.least(q, w), F.greatest(q, w)
    ratio = low / high
    prefix = s["prefix"] * (0.2 + 0.8 * q / w)
    prefix = F.when(w - q <= 3, F.least(F.lit(1.0), prefix + 0.08)).otherwise(prefix)
    at = F.call_function("locate", F.lower(query), variant) - 1
    inside = s["substring"] * (0.4 + 0.6 * q / w) - 0.5 * F.pow(at / F.length(variant), F.lit(3.0))
    inside = F.when(at < 0, F.lit(0.5 * s["substring"])).otherwise(inside)
    fuzzy = F.greatest(F.lit(s["fuzzy_min"]), s["fuzzy"] * ratio * (1 - 1.5 * edit / high))
    lift = F.when(edit <= 1, 0.15).when(edit <= 2, 0.08).otherwise(0.0)
    fuzzy = F.when(high <= 4, F.least(F.lit(1.0), fuzzy + lift)).otherwise(fuzzy)
    if an["enabled"]:
        fuzzy = F.when(is_alphanumeric(query) & is_alphanumeric(word), alphanumeric_score(query, word, config["max_edit_distance"], an["alpha"], an["numeric"], an["multiplier"])).otherwise(fuzzy)
    grams = jaccard(F.lower(query), normalized) if strict else jaccard(F.lower(query), F.lower(word))
    out = (
        F.when(type_ == "exact", F.lit(float(s["exact"])))
        .when(type_ == "prefix", prefix)
        .when(type_ == "substring", inside)
        .when(type_ == "phonetic", s["phonetic"] * (0.5 + 0.5 * ratio))
        .when(type_ == "fuzzy", fuzzy)
        .when(type_ == "synonym", s["synonym"] * (0.6 + 0.4 * ratio))
        .when(type_ == "compound", s["compound"] * (0.7 + 0.3 * ratio))
        .when(type_ == "ngram", s["ngram"] * grams)
        .otherwise(F.lit(float(mod["base_score"])))
    )
    if mod["short_word_boost"]:
        out = F.when((type_ != "exact") & (w <= q + mod["short_word_max_diff"]), out + mod["short_word_boost"]).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))
