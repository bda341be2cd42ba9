"""Search settings: defaults, presets, merging and checks."""

from __future__ import annotations

from copy import deepcopy

FEATURES = ("phonetic", "compound", "synonyms", "keyboard-neighbors", "partial-words", "missing-letters", "extra-letters", "transpositions")
#: Defaults and presets that results depend on.
DEFAULTS = {
    "languages": ["english"], "features": list(FEATURES), "max_results": 10, "min_query_length": 1, "fuzzy_threshold": 0.33, "max_edit_distance": 2, "ngram_size": 3,
    "performance": "balanced", "field_weights": {}, "custom_synonyms": {}, "stop_words": [], "enable_stop_words": False, "word_boundaries": False, "use_bm25": False, "bm25_weight": 0.6, "custom_normalizer": None,
    "alphanumeric": {"enabled": True, "alpha": 0.7, "numeric": 0.3, "multiplier": 1.5},
    "scores": {"exact": 1.0, "prefix": 0.97, "substring": 0.87, "phonetic": 0.40, "fuzzy": 0.70, "fuzzy_min": 0.30, "synonym": 0.45, "compound": 0.82, "ngram": 0.28},
    "modifiers": {"base_score": 0.0, "short_word_boost": 0.0, "short_word_max_diff": 3, "prefix_length_penalty": False},
}
PRESETS = {
    "fast": {"max_results": 3, "max_edit_distance": 3, "features": ["partial-words", "compound", "missing-letters", "extra-letters", "transpositions"], "scores": {"prefix": 0.93, "substring": 0.77, "fuzzy": 0.65, "fuzzy_min": 0.25, "ngram": 0.29}},
    "comprehensive": {"max_results": 20, "max_edit_distance": 3, "fuzzy_threshold": 0.27, "scores": {"prefix": 0.93, "substring": 0.80, "phonetic": 0.45, "synonym": 0.50, "compound": 0.75, "fuzzy": 0.65, "fuzzy_min": 0.15, "ngram": 0.35}},
}
LANGUAGE_FEATURES = {
    "german": ["phonetic", "compound", "synonyms", "keyboard-neighbors", "partial-words", "missing-letters", "extra-letters"],
    "english": ["phonetic", "synonyms", "keyboard-neighbors", "partial-words", "missing-letters", "transpositions"],
    "spanish": ["phonetic", "synonyms", "keyboard-neighbors", "partial-words", "missing-letters"],
    "french": ["phonetic", "synonyms", "keyboard-neighbors", "partial-words", "missing-letters"],
}
_NESTED = ("scores", "modifiers", "alphanumeric")


def merge(user: dict | None = None) -> dict:
    """Defaults, then the preset (performance other than balanced), then user. Languages without features bring those of the languages."""
    user = user or {}
    out = deepcopy(DEFAULTS)
    for layer in (PRESETS.get(user.get("performance", "balanced"), {}), user):
        for k, v in layer.items():
            if k not in DEFAULTS:
                raise ValueError(f"unknown setting {k}")
            out[k] = out[k] | v if k in _NESTED else deepcopy(v)
    if "languages" in user and "features" not in user:
        of = [LANGUAGE_FEATURES.get(lang, LANGUAGE_FEATURES["english"]) for lang in user["languages"]]
        out["features"] = list(dict.fromkeys(f for fs in of for f in fs))
    validate(out)
    return out


def validate(config: dict) -> None:
    checks = (
        (config["max_results"] >= 1, "max_results must be at least 1"),
        (config["min_query_length"] >= 1, "min_query_length must be at least 1"),
        (0 <= config["fuzzy_threshold"] <= 1, "fuzzy_threshold must be between 0 and 1"),
        (config["max_edit_distance"] >= 0, "max_edit_distance must not be negative"),
        (config["ngram_size"] >= 2, "ngram_size must be at least 2"),
        (len(config["languages"]) > 0, "at least one language is needed"),
    )
    for ok, says in checks:
        if not ok:
            raise ValueError(says)
