"""Personal data by weak supervision, in DataFrame operations only.

Strict patterns give the base spans (email, ip, card, phone), which always stay. Wider patterns propose further spans: secrets in
assignments, mails that are spelled out, phone numbers without a plus, numbers of identity papers and accounts. Every proposed span
gets votes (found, not found) from labelers: the shape of the span (regex), word lists around it (gazetteer: words that name such data in
four languages), the marks next to it (context), its mix of characters, and how often it repeats in its text.

Expectation-maximisation over the counts of vote patterns (at most KINDS * 2 ** LABELERS of them, whatever the corpus) estimates how reliable each
labeler is for spans that are personal data and for those that are not. The posteriors then train the final classifier, a
logistic regression on votes and kind, whose score is a column expression. Base spans take part in both as seen examples.

Spans count code points, end exclusive. All steps happen within a row but the count of vote patterns. Overlaps are found by sweeps over sorted spans, repeats by
sorting, and surroundings are cut from chunks of the text, so a text with a hundred thousand spans takes seconds; no pattern has an upper length.

Nulls: a null text is empty. Rows that repeat are judged alike; they count as often as they are there. Of proposed spans that overlap, the first stays, of those
that begin together the kind that is listed first. No rows give no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks_of, cut_of, fold, let, read, table

#: Base patterns; a match may begin at the end of the one before (\G) or where its first run of characters does, so no text is scanned twice.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "secret": r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|bearer)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z0-9+/_.-]{16})[A-Za-z0-9+/_-]++(?:\.[A-Za-z0-9+/_-]++)*+={0,2}",
    "spelled": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++\x20?[\[({]\x20?at\x20?[\])}]\x20?[a-z0-9-]++(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\.)[a-z0-9-]++)++",
    "local_phone": r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "paper": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
KINDS = (*BASE, *MORE)
#: A cheap test that every text with a match passes.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "secret": "[=:]", "spelled": r"[\[({]", "local_phone": "[0-9]", "paper": "-[0-9][0-9]-", "account": "[A-Z][A-Z][0-9][0-9]"}
#: Words near such data: fixed list, four languages.
GAZETTEER = (
    "mail|e-mail|email|correo|courriel|phone|tel|fax|mobile|telefon|handy|llámame|teléfono|téléphone|portable|call|contact|kontakt|contacto|token|secret|password|passwort|contraseña|"
    "passe|key|login|card|visa|credit|karte|kreditkarte|tarjeta|carte|iban|account|konto|cuenta|compte|ssn|passport|ausweis|dni|address|adresse|dirección|server|host"
)
AROUND = 32
LABELERS = ("shape", "words", "marks", "mixed", "once")


SPAN = "struct<kind:string,s:int,e:int,t:string>"


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, s, e, t) of the matches from left to right."""
    whole = rf"\G(?s)(.*?)({pattern})"
    parts = F.struct(F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("gaps"), F.regexp_extract_all(text, F.lit(whole), F.lit(2)).alias("hits"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return e, F.array(F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["hit"].alias("t")))

    pairs = let(parts, lambda p: F.transform(p["hits"], lambda h, i: F.struct(F.get(p["gaps"], i).alias("gap"), h.alias("hit"))))
    return F.when(text.rlike(NEEDS[kind]), fold(pairs, F.lit(0), step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    twice = lambda x: F.when(2 * x > 9, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 1, twice(x)).otherwise(F.coalesce(x, F.lit(0)))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda p: F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 4).cast("int") <= 255)
    if kind == "card":
        return luhn(_digits(t))
    if kind == "phone":
        return F.length(_digits(t)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, s, e, t) of the valid matches of the base patterns, by kind and start."""
    valid = lambda kind: lambda x: _valid(kind, x["t"])
    return F.concat(*[F.filter(_found(text, k, p), valid(k)) for k, p in BASE.items()])


def _votes(x: Column, before: Column, after: Column, often: Column) -> Column:
    """The span with a boolean for each labeler. before and after: what is around it; often: it occurs three times or more in its text."""
    t = x["t"]
    named = x["kind"].isin("secret", "spelled")
    votes = {
        "shape": F.when(x["kind"] == "secret", t.rlike(r"[0-9]") & t.rlike(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{20,}+=*+$")).when(x["kind"].isin("local_phone", "phone"), F.length(_digits(t)).between(9, 15)).when(x["kind"] == "paper", ~t.rlike("^(?:000|666|9)")).otherwise(F.lit(True)),
        "words": (F.concat(before, F.when(named, F.lower(t)).otherwise(F.lit("")))).rlike(rf"(?:^|[^\p{{L}}])(?:{GAZETTEER})(?:[^\p{{L}}]|$)"),
        "marks": before.rlike(r"[:=<(\"'#]\s*$") | after.rlike("^[\"'>)]") | F.when(named, t.rlike("[=:\\[({]")).otherwise(F.lit(False)),
        "mixed": F.size(F.array_distinct(F.split(t, ""))) >= 5,
        "once": ~often,
    }
    return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), *[F.coalesce(votes[n], F.lit(False)).alias(n) for n in LABELERS])


def _free(base: Column, wide: Column) -> Column:
    """Those of wide that overlap no span of base and none of wide that stays and is before them (by start, then kind as listed)."""
    placed = "struct<s:int,o:int,e:int,kind:string,t:string,base:boolean>"
    order = F.array(*map(F.lit, KINDS))

    def named(x: Column, is_base: bool) -> Column:
        place = F.lit(0) if is_base else F.array_position(order, x["kind"]).cast("int")
        return F.struct(x["s"].alias("s"), place.alias("o"), x["e"].alias("e"), x["kind"].alias("kind"), x["t"].alias("t"), F.lit(is_base).alias("base"))

    all_ = F.sort_array(F.concat(F.transform(base, lambda x: named(x, True)), F.transform(wide, lambda x: named(x, False))))
    none = F.array().cast(f"array<{placed}>")

    def from_right(next_: Column, x: Column) -> tuple[Column, Column]:  # next_: where the next base span begins
        return F.when(x["base"], x["s"]).otherwise(next_), F.when(x["base"] | (x["e"] <= next_), F.array(x)).otherwise(none)

    def from_left(end: Column, x: Column) -> tuple[Column, Column]:  # end: of what stays so far
        stays = x["base"] | (x["s"] >= end)
        return F.when(stays, F.greatest(end, x["e"])).otherwise(end), F.when(stays & ~x["base"], F.array(x)).otherwise(none)

    left = fold(F.reverse(all_), F.lit((1 << 31) - 1), from_right, placed)
    kept = fold(F.reverse(left), F.lit(0), from_left, placed)
    return F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t")))


def _often(spans: Column) -> Column:
    """For each span whether its text is that of two others too: equal texts are neighbours once sorted."""
    by_text = F.sort_array(F.transform(spans, lambda x, i: F.struct(x["t"].alias("t"), i.alias("i"))))

    def marked(v: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(v, k)["t"] == F.get(v, j)["t"], F.lit(False))
        return F.transform(v, lambda x, k: F.struct(x["i"].alias("i"), (same(k - 2, k) | (same(k - 1, k) & same(k, k + 1)) | same(k, k + 2)).alias("often")))

    return F.when(F.size(spans) < 3, F.transform(spans, lambda x: F.lit(False))).otherwise(F.transform(F.sort_array(let(by_text, marked)), lambda x: x["often"]))


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, base and more: spans with their votes; more holds no span that overlaps a base span or one proposed before it."""
    text = F.coalesce("text", F.lit(""))
    typed = F.array().cast(f"array<{SPAN}>")

    def more(base: Column) -> Column:
        wide = F.concat(*[_found(text, k, p) for k, p in MORE.items()])
        return let(wide, lambda w: F.when(F.size(w) > 0, _free(base, w)).otherwise(typed))

    def voted(v: Column) -> Column:
        def one(x: Column, i: Column, a: Column) -> Column:
            before = F.lower(cut_of(a["chunks"], F.greatest(x["s"] - AROUND, F.lit(0)), x["s"]))
            return _votes(x, before, cut_of(a["chunks"], x["e"], x["e"] + 2), F.get(a["often"], i))

        around = F.struct(chunks_of(text).alias("chunks"), _often(F.concat(v["base"], v["more"])).alias("often"))

        def both(a: Column) -> Column:
            base = F.transform(v["base"], lambda x, i: one(x, i, a))
            return F.struct(base.alias("base"), F.transform(v["more"], lambda x, i: one(x, i + F.size(v["base"]), a)).alias("more"))

        return let(around, both)

    none = F.array().cast("array<struct<kind:string,s:int,e:int," + ",".join(f"{n}:boolean" for n in LABELERS) + ">>")
    spans = let(base_spans(text), lambda b: F.struct(b.alias("base"), more(b).alias("more")))
    empty = F.struct(none.alias("base"), none.alias("more"))
    votes = let(spans, lambda v: F.when(F.size(v["base"]) + F.size(v["more"]) > 0, voted(v)).otherwise(empty))
    return docs.select("doc_id", votes.alias("v")).select("doc_id", "v.base", "v.more")


def learn(counts: list[tuple[str, bool, tuple[bool, ...], int]], rounds: int = 50) -> tuple[dict, tuple[float, dict, list[float]]]:
    """counts: kind, base, votes, number. Reliabilities (labeler: P(vote | personal), P(vote | not)) by expectation-maximisation, and the
    logistic classifier (bias, weight of each kind, weight of each labeler) fitted to the posteriors."""
    if not counts:
        return {}, (0.0, {}, [0.0] * len(LABELERS))
    n = len(LABELERS)
    total = sum(c for *_, c in counts)
    prior, hit, miss = 0.7, [0.8] * n, [0.3] * n
    post = [0.0] * len(counts)
    for _ in range(rounds):
        for k, (_, base, votes, _) in enumerate(counts):
            yes, no = math.log(prior), math.log(1 - prior)
            for v, h, m in zip(votes, hit, miss, strict=True):
                yes += math.log(h if v else 1 - h)
                no += math.log(m if v else 1 - m)
            post[k] = 1.0 if base else 1 / (1 + math.exp(min(700.0, no - yes)))
        held = sum(p * c for p, (*_, c) in zip(post, counts, strict=True))
        prior = min(0.99, max(0.01, held / total))
        for j in range(n):
            yes = sum(p * c for p, (_, _, v, c) in zip(post, counts, strict=True) if v[j])
            no = sum((1 - p) * c for p, (_, _, v, c) in zip(post, counts, strict=True) if v[j])
            hit[j], miss[j] = ((a + s) / (b + s + t) for a, b, s, t in ((yes, held, 4.0, 1.0), (no, total - held, 1.0, 4.0)))  # beta priors: a vote speaks for
    bias, kinds, weights = 0.0, {k: 0.0 for k, *_ in counts}, [0.0] * n
    for _ in range(400):
        g_bias, g_kind, g = 0.0, dict.fromkeys(kinds, 0.0), [0.0] * n
        for p, (kind, _, votes, c) in zip(post, counts, strict=True):
            z = bias + kinds[kind] + sum(w for w, v in zip(weights, votes, strict=True) if v)
            d = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * c / total
            g_bias += d
            g_kind[kind] += d
            g = [x + d * v for x, v in zip(g, votes, strict=True)]
        bias += g_bias
        kinds = {k: w + g_kind[k] - 1e-3 * w for k, w in kinds.items()}
        weights = [w + x - 1e-3 * w for w, x in zip(weights, g, strict=True)]
    return {name: (h, m) for name, h, m in zip(LABELERS, hit, miss, strict=True)}, (bias, kinds, weights)


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, s, e by start, then kind as listed), for every row of docs."""
    held = table(proposals(docs), "proposals")  # read by the result, so it stays
    seen = held.select(F.explode(F.concat(F.transform("base", lambda x: F.struct(F.lit(True).alias("b"), x.alias("x"))), F.transform("more", lambda x: F.struct(F.lit(False).alias("b"), x.alias("x"))))).alias("v"))
    counted = seen.groupBy("v.x.kind", "v.b", *[f"v.x.{n}" for n in LABELERS]).count().collect()  # a row a vote pattern
    _, (bias, kinds, weights) = learn(sorted((r["kind"], r["b"], tuple(r[n] for n in LABELERS), r["count"]) for r in counted))

    def score(x: Column) -> Column:
        got = F.lit(bias)
        for k, w in kinds.items():
            got = got + F.when(x["kind"] == k, F.lit(w)).otherwise(F.lit(0.0))
        for name, w in zip(LABELERS, weights, strict=True):
            got = got + F.when(x[name], F.lit(w)).otherwise(F.lit(0.0))
        return got

    return held.select("doc_id", _in_order(F.col("base")).alias("base"), _in_order(F.concat("base", F.filter("more", lambda x: score(x) >= 0))).alias("spans"))


def _in_order(spans: Column) -> Column:
    """kind, s, e by start, then kind as listed."""
    kinds = F.array(*map(F.lit, KINDS))
    placed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.array_position(kinds, x["kind"]).alias("o"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.transform(F.sort_array(placed), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span (by start) replaced by its kind in brackets; what a later span adds to one that it overlaps goes too."""

    def made(chunks: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            new = F.array(cut_of(chunks, at, x["s"]), F.concat(F.lit("["), x["kind"], F.lit("]")))
            return F.greatest(at, x["e"]), F.when(x["s"] >= at, new).otherwise(F.array().cast("array<string>"))

        end = F.array_max(F.transform(spans, lambda x: x["e"]))
        return F.array_join(F.concat(fold(spans, F.lit(0), step, "string"), F.array(cut_of(chunks, end, F.length(text)))), "")

    return F.when(F.size(spans) > 0, let(chunks_of(text), made)).otherwise(text)


def _digest(df: DataFrame, base: str, *also: Column) -> DataFrame:
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *[count(k) for k in BASE], F.sha2(written(F.col(base)), 256).alias("base_sha256"), *also)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return _digest(detected(read(spark, sf_dir, "documents")), "base", written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def pii_base(spark, sf_dir: str) -> DataFrame:
    """The base spans alone, as op2_pii has them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", _in_order(base_spans(F.coalesce("text", F.lit("")))).alias("base"))
    return _digest(docs, "base")


_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_EACH = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, {n} AS o, regexp_extract_all(t, '(?s)(.*?)({p})', 1) AS gaps, regexp_extract_all(t, '(?s)(.*?)({p})', 2) AS hits FROM d" for n, (k, p) in enumerate(_PLAIN.items())
)
BASE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_EACH}),
e AS (SELECT doc_id, kind, o, unnest(hits) AS hit, unnest(gaps) AS gap, unnest(range(len(hits))) AS i FROM m),
p AS (SELECT *, (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS stop FROM e),
v AS (SELECT *, stop - length(hit) AS start, regexp_replace(hit, '[^0-9]', '', 'g') AS g FROM p),
k AS (SELECT * FROM v WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(g) BETWEEN 9 AND 15
  WHEN 'ip' THEN list_max(list_transform(string_split(hit, '.'), lambda x: coalesce(try_cast(x AS BIGINT), 999))) <= 255
  ELSE length(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(g)), lambda j: CASE WHEN j % 2 = 0 THEN g[length(g) - j]::INT WHEN g[length(g) - j]::INT > 4 THEN g[length(g) - j]::INT * 2 - 9 ELSE g[length(g) - j]::INT * 2 END)) % 10 = 0 END)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in _PLAIN)},
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o), '')) AS base_sha256
FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""
