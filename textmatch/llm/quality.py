"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule's cost (seconds over a sample, less those of reading it) and selectivity (share of sampled documents that it rejects)
are measured, and the rules run in the order of rejections per second; a document that one rejects is not shown to the later
ones. The order decides how long a run takes, never its verdict: a document is kept if no rule rejects it.

Everything happens within a row, so there is no shuffle but that of the sample. Repeated windows are found by sorting the window
hashes of one text, never by comparing all of them.

Nulls: a null text is empty (no words, base_failed). Rows that repeat are judged alike. No rows give no rows, and rules in the order given. Rules of equal rates keep the
order given; the seconds are wall-clock, so the order may differ between runs, the verdicts never do. A long text is one row, in time n log n in its words.
Columns other than text pass through whatever their names; those that begin with __tm_ are taken.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, read, scratch, table, words_of

MIN_WORDS = 50
#: Documents in the sample on which the order of the rules is settled.
SAMPLE_ROWS = 2000
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more, each word once."""
    sort = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    twice = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"])), lambda x: x["p"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n"), p.alias("at"))
    return let(sort(hashes), lambda s: F.aggregate(twice(s), start, step, lambda a: a["n"]))


def _repeated(words: Column) -> Column:
    hashes = F.slice(F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.size(words) - (WINDOW - 1))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(found)


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words, all long."""
    text = F.coalesce(text, F.lit(""))
    long = lambda c, name: c.cast("long").alias(name)
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"), _repeated(w).alias("rep")))
    made = F.struct(words.alias("w"), lines.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).alias("s"))
    return let(made, lambda m: F.struct(long(m["w"]["n"], "n_words"), long(m["w"]["chars"], "word_chars"), long(m["s"], "n_symbols"), long(m["l"]["n"], "n_lines"), long(m["l"]["dup"], "n_dup_lines"), long(m["w"]["rep"], "n_repeat_words")))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


@dataclass(frozen=True)
class Rule:
    """rejects(text, measures) is a boolean Column."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _share(text: Column, of: str, among: str, percent: int) -> Column:
    """More than percent of the characters in class among are in class of."""
    return 100 * F.regexp_count(text, F.lit(of)) > percent * F.regexp_count(text, F.lit(among))


#: Limits in the manner of the published rules for web text; whole numbers, so that every engine agrees.
RULES = (
    Rule("symbols", lambda t, m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", lambda t, m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("repeated_lines", lambda t, m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("capitals", lambda t, m: _share(t, "[A-Z]", "[A-Za-z]", 60)),
    Rule("digits", lambda t, m: _share(t, "[0-9]", r"[^\x20\x09-\x0D]", 40)),
    Rule("ellipses", lambda t, m: 10 * F.regexp_count(t, F.lit(r"(?:\.\.\.|\x{2026})\n")) > 3 * m["n_lines"]),
    Rule("placeholder", lambda t, m: F.lower(t).contains("lorem ipsum")),
)


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) in the order of rejections per second. The sample is drawn from all rows."""
    n = docs.count()
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    drawn = docs.select(F.coalesce("text", F.lit("")).alias("t")).sample(min(1.0, sample_rows / n), seed).repartition(4)
    with scratch(docs.sparkSession):
        held = table(drawn.select("t", measures(F.col("t")).alias("m")), "rule-sample").where(~base_failed(F.col("m")))

        def run(c: Column) -> tuple[float, float]:
            plan, best = held.agg(F.avg(F.coalesce(c, F.lit(False)).cast("double"))), float("inf")
            for _ in range(2):  # the first compiles
                began = time.perf_counter()
                share = plan.first()[0]
                best = min(best, time.perf_counter() - began)
            return best, share or 0.0

        idle = run(F.length("t") < 0)[0]
        found = [(r, max(1e-3, s - idle), share) for r in rules for s, share in [run(r.rejects(F.col("t"), F.col("m")))]]
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(text: Column, m: Column, rules: list[Rule]) -> Column:
    """True if no rule rejects; later rules are evaluated only for what the earlier ones let through."""
    out = F.when(base_failed(m), F.lit(False))
    for r in rules:
        out = out.when(F.coalesce(r.rejects(text, m), F.lit(False)), F.lit(False))
    return out.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with __tm_m (see measures) and __tm_kept."""
    order = [r for r, *_ in ordered(docs, rules, sample_rows)]
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("__tm_m", measures(F.col("text"))).withColumn("__tm_kept", cascade(text, F.col("__tm_m"), order))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns."""
    return judged(docs, rules, sample_rows).where("__tm_kept").select(*docs.columns)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    got = judged(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *[f"__tm_m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(F.col("__tm_m")).alias("base_failed"), F.col("__tm_kept").alias("kept"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, t, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines
    OR 100 * len(regexp_extract_all(t, '[A-Z]')) > 60 * len(regexp_extract_all(t, '[A-Za-z]'))
    OR 100 * len(regexp_extract_all(t, '[0-9]')) > 40 * len(regexp_extract_all(t, '[^\x20\x09-\x0D]'))
    OR 10 * len(regexp_extract_all(t, '(?:\.\.\.|\x{2026})\n')) > 3 * n_lines OR contains(lower(t), 'lorem ipsum')) AS kept
FROM b
"""
