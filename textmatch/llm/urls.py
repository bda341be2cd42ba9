"""URL verdicts: rules first, then gradient-boosted trees on lexical features.

The trees are trained on labelled URLs: the caller's, else those of seed_labels(), which no table of pages is needed for. At most TRAIN_ROWS of them,
those with the smallest seeded hash, fit a logistic loss with second-order boosting on binned features. Suffix statistics (how often a host's last
label was blocked, and how often it was seen) are counted over all labelled URLs; a URL that is trained on sees those of the other FOLDS - 1 folds only, so its own
label does not leak into them. The fitted trees become one column expression, so scoring runs in the JVM wherever the URLs are; nothing
but the suffix table, a row a suffix, is joined.

Nulls: a null url, or one without "://", has an empty host and path, fits no rule and is judged by its features. Rows that repeat are judged alike; labelled
URLs that repeat count as often as they are there. Rules of equal length: the earlier one wins. A score of 0 (even odds) allows. Null labels are not used.
Without labelled URLs, or with labels all alike, the trees give the one label known (allow if there is none). No pages give no rows. A long URL is one row in
time in proportion to its length times its distinct characters. Columns other than page_id and url are not read.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, read

#: (verdict, host, path) in the order given; the longest that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
SEED, FOLDS = 11, 5
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_rate", "suffix_seen")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits, else nulls."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        got = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, got) if out is None else out.when(fits, got)
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return out.otherwise(none) if out is not None else none


def _entropy(text: Column) -> Column:
    """Bits a character, from the counts of the distinct characters."""
    chars = F.array_distinct(F.split(text, ""))
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def features(url: Column, host: Column, path: Column, rate: Column, seen: Column) -> Column:
    """Array of doubles in the order of FEATURES."""
    url = F.coalesce(url, F.lit(""))
    count = lambda c, of: F.size(F.split(c, of)) - 1
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1))
    got = (F.length(url), F.length(host), F.length(path), count(path, "/"), count(host, r"\.") + 1, digits, _entropy(host), F.when(query != "", count(query, "&") + 1).otherwise(0), count(url, "-"), rate, F.log1p(seen))
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in got])


class Trees:
    """Second-order boosting of depth-limited trees on quantile bins."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE):
        self.n, self.depth, self.bins, self.rate, self.trees, self.base = trees, depth, bins, rate, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        mean = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        if len(np.unique(y)) < 2:
            return self
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)])  # v <= cut[k]: code <= k
        score = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(codes, p - y, p * (1 - p), np.arange(len(y)), self.depth, score)
            self.trees.append(tree)
        return self

    def _grow(self, codes, g, h, rows, depth, score):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if depth and len(rows) > 1:
            for f, cuts in enumerate(self.cuts):
                c = codes[f, rows]
                left_g, left_h = (np.cumsum(np.bincount(c, w[rows], len(cuts) + 1))[:-1] for w in (g, h))
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                gain[(left_h < 1e-3) | (total_h - left_h < 1e-3)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), (f, int(gain.argmax())))
        if best[1] is None:
            value = float(-self.rate * total_g / (total_h + 1))
            score[rows] += value
            return value
        f, k = best[1]
        left = codes[f, rows] <= k
        return f, float(self.cuts[f][k]), self._grow(codes, g, h, rows[left], depth - 1, score), self._grow(codes, g, h, rows[~left], depth - 1, score)

    def score(self, x: Column) -> Column:
        def walk(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(F.get(x, F.lit(t[0])) <= t[1], walk(t[2])).otherwise(walk(t[3]))

        return sum((walk(t) for t in self.trees), F.lit(self.base))


#: What seed_labels draws from: for plain and for blocked URLs the chance of each trait, so that the classes overlap in all of them.
SUFFIXES = {"com": (40, 34), "org": (20, 8), "net": (13, 14), "edu": (8, 1), "info": (5, 12), "io": (5, 3), "de": (6, 4), "xyz": (1, 11), "top": (1, 8), "click": (1, 5)}
TRAITS = {"https": (0.75, 0.55), "www": (0.45, 0.3), "subdomain": (0.15, 0.4), "hyphen": (0.2, 0.4), "digits": (0.08, 0.35), "random": (0.03, 0.25), "slug": (0.5, 0.3), "number": (0.4, 0.5)}
DEPTHS, PARAMETERS, NOISE = (2.0, 2.6), (0.35, 1.7), 0.05
#: Syllables, parameter names and endings of paths of the two shapes.
SHAPES = (
    (("ba", "de", "fi", "go", "lu", "me", "no", "pa", "ri", "so", "ta", "ve"), ("id", "ref", "page", "src", "utm_source", "sid"), ("", "", "/", ".html")),
    (("ched", "kor", "plim", "wex", "stu", "thra", "yol", "zin", "qua", "brej"), ("q", "lang", "aff", "campaign", "token", "v"), ("", ".php", "/index", "#part")),
)


def seed_labels(n: int = 6000, seed: int = SEED, shape: int = 0) -> list[tuple[str, int]]:
    """n pairs (url, label; 1: block), drawn by the chances above, with NOISE of the labels turned around. shape: words and endings."""
    rng = random.Random(seed)  # noqa: S311
    syllables, names, endings = SHAPES[shape]
    word = lambda lo=2, hi=4: "".join(rng.choice(syllables) for _ in range(rng.randint(lo, hi)))

    def count(mean: float) -> int:
        k, p, u = 0, math.exp(-mean), rng.random()
        total = p
        while u > total and k < 20:
            k += 1
            p *= mean / k
            total += p
        return k

    out = []
    for _ in range(n):
        label = int(rng.random() < 0.5)
        has = {t: rng.random() < chance[label] for t, chance in TRAITS.items()}
        name = "".join(rng.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(rng.randint(8, 16))) if has["random"] else ("-" if has["hyphen"] else "").join(word() for _ in range(rng.randint(1, 2 + label)))
        name += str(rng.randint(1, 9999)) if has["digits"] else ""
        host = ("www." if has["www"] else "") + (f"{word(1, 2)}." if has["subdomain"] else "") + name
        host += "." + rng.choices(list(SUFFIXES), [w[label] for w in SUFFIXES.values()])[0]
        parts = ["-".join(word() for _ in range(rng.randint(2, 6))) if has["slug"] and rng.random() < 0.5 else word(1, 3) for _ in range(count(DEPTHS[label]))]
        parts += [str(rng.randint(1, 10 ** rng.randint(2, 5 + 3 * label)))] if has["number"] else []
        query = "&".join(f"{rng.choice(names)}={rng.choice([word(), str(rng.randint(1, 10**6))])}" for _ in range(count(PARAMETERS[label])))
        url = f"{'https' if has['https'] else 'http'}://{host}/{'/'.join(parts)}{rng.choice(endings) if parts else ''}{'?' + query if query else ''}"
        out.append((url, label ^ (rng.random() < NOISE)))
    return out


def _parted(df: DataFrame) -> DataFrame:
    df = df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return df.withColumn("suffix", F.substring_index("host", ".", -1))


def _vector(blocked: Column, seen: Column) -> Column:
    blocked, seen = F.coalesce(blocked, F.lit(0)), F.coalesce(seen, F.lit(0))
    return features(F.col("url"), F.col("host"), F.col("path"), (blocked + 1) / (seen + 2), seen)


def trained(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[Trees, DataFrame]:
    """The trees, and the suffix statistics: suffix, blocked, seen."""
    known = _parted(labelled.select("url", F.col("label").cast("int").alias("label"), F.xxhash64(F.lit(SEED), "url").alias("place")).where("label is not null"))
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.lit(SEED + 1), "url"), F.lit(FOLDS)).cast("int"))
    folds = known.groupBy("suffix", "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("seen"))
    stats = folds.groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.sum("seen").alias("seen"))
    likely = F.pmod("place", F.lit(1 << 20)) < F.lit(2 * train_rows * (1 << 20) // max(1, known.count()))  # so that few rows are ranked
    drawn = known.where(likely).orderBy("place", "url", "label").limit(train_rows)
    own = folds.select("suffix", "fold", F.col("blocked").alias("own_blocked"), F.col("seen").alias("own_seen"))
    seen = drawn.join(stats, "suffix").join(own, ["suffix", "fold"])
    vector = _vector(F.col("blocked") - F.col("own_blocked"), F.col("seen") - F.col("own_seen"))
    rows = seen.select("place", "url", "label", vector.alias("x")).orderBy("place", "url", "label").toArrow()  # at most train_rows
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return Trees().fit(x, np.array(rows.column("label").to_pylist(), float)), stats


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, url, host, path, rule, verdict, block_score for every row of pages. labelled: url, label (1: block)."""
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(seed_labels(), "url string, label int")
    trees, stats = trained(labelled, train_rows)
    scored = _parted(pages.select("page_id", "url")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).join(stats, "suffix", "left")
    scored = scored.withColumn("block_score", let(_vector(F.col("blocked"), F.col("seen")), trees.score))
    method = F.when(F.col("block_score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "block_score")


def url_rules(spark, sf_dir: str) -> DataFrame:
    """What the rules alone say: page_id, host, path, rule, ruled (null where the trees decide)."""
    pages = _parted(read(spark, sf_dir, "pages").select("page_id", "url")).withColumn("r", rule_of(F.col("host"), F.col("path")))
    return pages.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))


RULES_SQL = f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(host_, path_, ruled_) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in RULES)}),
f AS (SELECT page_id, host_ || path_ AS rule, ruled_ AS ruled, row_number() OVER (PARTITION BY page_id ORDER BY length(host_ || path_) DESC) AS n
  FROM p JOIN r ON (host = host_ OR ends_with(host, '.' || host_)) AND starts_with(path, path_))
SELECT p.page_id, host, path, rule, ruled FROM p LEFT JOIN (SELECT * FROM f WHERE n = 1) f ON p.page_id = f.page_id
"""


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
