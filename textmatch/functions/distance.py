"""Distances and similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import active
from .text import alpha_part, ngrams, numeric_part, segments


def levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """Edit distance; beyond most it is most + 1."""
    if most is None:
        return F.levenshtein(a, b)
    got = F.levenshtein(a, b, most)
    return F.when(got < 0, F.lit(most + 1)).otherwise(got)


def damerau(a: str, b: str, most: int | None = None) -> int:
    """Edit distance with transpositions, also of letters that other edits have brought together. Beyond most it is most + 1."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    far = len(a) + len(b)
    rows: list[list[int]] = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            same = x == y
            if same:
                match = j
            swap = rows[k][m] + (i - k - 1) + 1 + (j - m - 1) if k and m else far
            row.append(min(rows[i][j] + (not same), row[j] + 1, rows[i][j + 1] + 1, swap))
        rows.append(row)
        seen[x] = i
    got = rows[-1][-1]
    return got if most is None or got <= most else most + 1


def damerau_levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """damerau over Arrow batches; put cheaper conditions first."""
    active()

    @F.pandas_udf("int")
    def run(x, y):
        import pandas as pd

        from textmatch.functions.distance import damerau

        return pd.Series([None if p is None or q is None else damerau(p, q, most) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


def jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Of the sets of n-grams; equal texts are 1, an empty one is 0."""
    x, y = ngrams(a, n), ngrams(b, n)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def similarity(distance: Column, longest: Column) -> Column:
    return F.when(longest == 0, F.when(distance == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - distance / longest))


def are_similar(a: Column, b: Column, threshold: float = 0.8) -> Column:
    near = (F.abs(F.length(a) - F.length(b)) <= 2) & (jaccard(a, b) >= threshold - 0.2)
    return near & (similarity(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))) >= threshold)


def alphanumeric_score(query: Column, word: Column, max_edit: int, alpha: float = 0.7, numeric: float = 0.3, multiplier: float = 1.5) -> Column:
    """Weighted similarity of the letters and of the digits of two texts, 0.3 at least."""
    a, b = alpha_part(F.lower(query)), alpha_part(F.lower(word))
    x, y = numeric_part(query), numeric_part(word)
    most = -int(-max_edit * multiplier // 1)

    def part(p: Column, q: Column, k: int) -> Column:
        return F.greatest(F.lit(0.0), 1 - levenshtein(p, q, k) / F.greatest(F.length(p), F.length(q)))

    letters = F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(part(a, b, max_edit))
    inside = F.contains(x, y) | F.contains(y, x)
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    digits = F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.3).when(x == y, 1.0).when(inside, ratio).otherwise(part(x, y, most))
    return F.greatest(F.lit(0.3), alpha * letters + numeric * digits)


def compare_segments(a: Column, b: Column) -> Column:
    """Mean likeness of the runs of letters and digits of two texts, run by run: letters by their common beginning, digits by containment
    or else by the digits that agree; runs of different kinds, or without a partner, are 0."""
    common = lambda x, y: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(x), F.length(y)))), lambda k: F.substring(x, F.lit(1), k) == F.substring(y, F.lit(1), k)))
    agree = lambda x, y: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(x), F.length(y)))), lambda k: F.substring(x, k, F.lit(1)) == F.substring(y, k, F.lit(1))))
    longest = lambda x, y: F.greatest(F.length(x), F.length(y))

    def one(x: Column, y: Column) -> Column:
        contained = F.contains(x, y) | F.contains(y, x)
        digits = F.when(contained, F.least(F.length(x), F.length(y)) / longest(x, y)).otherwise(agree(x, y) / longest(x, y))
        return F.when(x == y, 1.0).when(x.rlike("^[A-Za-z]") & y.rlike("^[A-Za-z]"), common(x, y) / longest(x, y)).when(x.rlike("^[0-9]") & y.rlike("^[0-9]"), digits).otherwise(0.0)

    p, q = segments(F.lower(a)), segments(F.lower(b))
    scores = F.zip_with(p, q, lambda x, y: F.coalesce(one(x, y), F.lit(0.0)))
    return F.when(F.greatest(F.size(p), F.size(q)) > 0, F.aggregate(scores, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(p), F.size(q))).otherwise(F.lit(1.0))
