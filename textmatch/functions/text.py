"""Text functions as columns: accents, tokens, grams, segments, boundaries, wildcards, stop words, languages, phrases."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that lose their accent without being a base letter and marks.
FOLDS = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "þ": "th", "Þ": "TH", "ø": "o", "Ø": "O", "ð": "d", "đ": "d", "Ð": "D", "Đ": "D", "ħ": "h", "Ħ": "H", "ŀ": "l", "Ŀ": "L", "ł": "l", "Ł": "L", "ŧ": "t", "Ŧ": "T"}
#: Characters that separate tokens.
SEPARATORS = r"[\s\-_.,;:!?()\[\]{}'\"/\\#@$%^&*+=<>|~`]"
#: Stop words by language.
STOP_WORDS = {
    "english": "a an and are as at be by for from has he in is it its of on that the to was will with the this but they have had what when where who which why how".split(),
    "german": "der die das den dem des ein eine einer eines einem einen und oder aber ist sind war waren hat haben wird werden von zu im am um auf für mit nach bei aus".split(),
    "spanish": "el la los las un una unos unas de del y o pero es son era fueron ha han en a al con por para sin sobre entre".split(),
    "french": "le la les un une des du de et ou mais est sont était étaient a ont à au aux avec pour par dans sur sous entre".split(),
}
#: Letters that point to a language, and codes of languages.
LETTERS = {"german": "äöüßÄÖÜ", "french": "àâäæçéèêëïîôùûüÿœÀÂÄÆÇÉÈÊËÏÎÔÙÛÜŸŒ", "spanish": "áéíóúñü¿¡ÁÉÍÓÚÑÜ"}
CODES = {"en": "english", "de": "german", "fr": "french", "es": "spanish", "eng": "english", "deu": "german", "fra": "french", "esp": "spanish"}


@cache
def _plain() -> tuple[str, str]:
    """Letters with marks and the letters without, over all of the basic plane, by decomposition."""
    pairs = []
    for k in range(0xC0, 0xFFFF):
        c = chr(k)
        if c not in FOLDS and not 0xD800 <= k <= 0xDFFF and not 0xAC00 <= k <= 0xD7A3:
            base = "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ")
            if len(base) == 1 and base != c:
                pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def remove_accents(text: Column) -> Column:
    singles = [(a, b) for a, b in FOLDS.items() if len(b) == 1]
    marked, plain = _plain()
    out = F.translate(F.regexp_replace(text, "[̀-ͯ]", ""), marked + "".join(a for a, _ in singles), plain + "".join(b for _, b in singles))
    for a, b in FOLDS.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(text.rlike("[^\\x00-\\x7F]"), out).otherwise(text)


def strip_accents(text: str) -> str:
    """remove_accents for one string."""
    return "".join(x for c in text for x in (FOLDS.get(c) or unicodedata.normalize("NFD", c)) if not "̀" <= x <= "ͯ")


def has_accents(text: Column) -> Column:
    return remove_accents(text) != text


def normalize_for_comparison(text: Column) -> Column:
    return remove_accents(F.lower(text))


def accent_variants(text: Column) -> Column:
    return F.array_distinct(F.array(text, remove_accents(text)))


def tokens(text: Column, min_length: int = 1, lowercase: bool = True, keep_empty: bool = False) -> Column:
    parts = F.split(F.lower(text) if lowercase else text, SEPARATORS + "+")
    return parts if keep_empty else F.filter(parts, lambda x: F.length(x) >= min_length)


def token_positions(text: Column) -> Column:
    """Array of token, start, end."""
    inverse = SEPARATORS.replace("[", "[^", 1)
    found = F.regexp_extract_all(text, F.lit(f"({SEPARATORS}*)({inverse}+)"), F.lit(0))
    word = lambda x: F.regexp_replace(x, f"^{SEPARATORS}+", "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<token:string,start:int,end:int>>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.concat(a["out"], F.array(F.struct(word(x).alias("token"), (a["at"] + F.length(x) - F.length(word(x))).alias("start"), (a["at"] + F.length(x)).alias("end")))).alias("out"))
    return F.aggregate(found, start, step, lambda a: a["out"])


def join_tokens(words: Column, joint: str = " ") -> Column:
    return F.array_join(words, joint)


def normalize_for_search(text: Column) -> Column:
    """Tokens in lower case, joined by single spaces."""
    return join_tokens(tokens(text))


def is_separator(c: Column) -> Column:
    return c.rlike(f"^{SEPARATORS}$")


def ngrams(text: Column, n: int = 3) -> Column:
    """Runs of n characters in order; the text itself if it is shorter."""
    return F.when(F.length(text) < n, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def alpha_part(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z]", "")


def numeric_part(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def is_alphanumeric(text: Column) -> Column:
    return text.rlike("[A-Za-z]") & text.rlike("[0-9]")


def segments(text: Column) -> Column:
    """Runs of letters, digits and others in order."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))


def contains_word(text: Column, word: Column, boundaries: bool = False) -> Column:
    """word occurs in text, with boundaries only between separators or ends."""
    if not boundaries:
        return F.contains(F.lower(text), F.lower(word))
    marked = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), SEPARATORS, " "), F.lit(" "))
    return F.contains(marked, F.concat(F.lit(" "), F.regexp_replace(F.lower(word), SEPARATORS, " "), F.lit(" ")))


def starts_word(text: Column, word: Column) -> Column:
    """word begins text or follows a character that is no ASCII letter, digit or underscore."""
    quoted = F.regexp_replace(F.lower(word), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.when(word.rlike("^[A-Za-z0-9_]"), F.lit("(?:^|[^a-z0-9_])")).otherwise(F.lit("(?<=[a-z0-9_])")), quoted))


def boundary_matches(text: Column, word: Column) -> Column:
    """Starts of word in text between separators or ends, overlapping ones included."""
    low, n = F.lower(text), F.length(word)
    edge = lambda c: (c == "") | c.rlike(SEPARATORS)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    hit = lambda i: (F.substring(low, i, n) == F.lower(word)) & edge(F.when(i > 1, F.substring(low, i - 1, F.lit(1))).otherwise("")) & edge(F.substring(low, i + n, F.lit(1)))
    return F.transform(F.filter(starts, hit), lambda i: i - 1)


def wildcard_pattern(pattern: Column) -> Column:
    """A regular expression for a pattern in which * stands for any text."""
    return F.concat(F.lit("(?is)^"), F.replace(F.regexp_replace(pattern, r"([\\^$.|?+()\[\]{}])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))


def matches_wildcard(text: Column, pattern: Column) -> Column:
    return F.regexp_like(text, wildcard_pattern(pattern))


def drop_stop_words(text: Column, words: list[str]) -> Column:
    """text without stop words; as it is if nothing else is in it."""
    held = F.array(*[F.lit(w.lower()) for w in words]) if words else F.array().cast("array<string>")
    kept = F.filter(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: ~F.array_contains(held, F.lower(x)))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)


def stop_words_of(languages: list[str]) -> list[str]:
    return list(dict.fromkeys(w for name in languages for w in STOP_WORDS.get(name, [])))


def is_stop_word(word: Column, words: list[str]) -> Column:
    return F.lower(word).isin([w.lower() for w in words])


def languages_of(text: Column) -> Column:
    """english and each language one of whose letters occurs."""
    return F.array_compact(F.array(F.lit("english"), *[F.when(text.rlike(f"[{chars}]"), F.lit(name)) for name, chars in LETTERS.items()]))


def language_confidence(text: Column) -> Column:
    """Map of language to confidence: 0.5, and ten times the share of its letters on top, 1 at most."""
    pairs = [F.lit("english"), F.lit(0.5)]
    for name, chars in LETTERS.items():
        hits = F.regexp_count(text, F.lit(f"[{chars}]"))
        pairs += [F.lit(name), F.when(hits > 0, F.least(F.lit(1.0), 0.5 + 10.0 * hits / F.length(text)))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def language_code(text: Column) -> Column:
    lower = F.lower(text)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), lower), lower)


def is_valid_language(text: Column) -> Column:
    return F.lower(text).isin("english", "german", "french", "spanish", "auto")


#: Words in a phrase at most.
PHRASE_WORDS = 10


def parse_phrases(query: str) -> tuple[list[str], list[str]]:
    """(phrases, terms): quoted parts of up to PHRASE_WORDS words, double quotes first, and the words outside."""
    phrases, rest = [], query
    for mark in "\"'":
        pattern = re.compile(f"{mark}([^{mark}]+){mark}")
        phrases += [p for m in pattern.finditer(query) if (p := m[1].strip()) and len(p.split()) <= PHRASE_WORDS]
        rest = pattern.sub(" ", rest)
    return list(dict.fromkeys(phrases)), [w for w in re.sub("[\"']", " ", rest).split() if w]


def has_phrases(query: Column) -> Column:
    return query.rlike("\"[^\"]+\"|'[^']+'")


def normalize_phrase(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def split_phrase_words(phrase: Column) -> Column:
    """Words of a phrase in lower case."""
    return F.filter(F.split(normalize_phrase(phrase), " "), lambda w: w != "")
