import pytest

from textmatch import config, languages
from textmatch.functions import distance, text
from textmatch.sources.content import json_strings

L = languages.REGISTRY


@pytest.mark.parametrize(("lang", "word", "code"), [("german", "krankenhaus", "470640608"), ("english", "doctor", "TKTR"), ("english", "smith", "SM0"), ("english", "smyth", "SM0"), ("english", "knight", "NT"), ("english", "night", "NT"), ("english", "city", "STY"), ("spanish", "casa", "4080"), ("french", "maison", "60806"), ("english", "", ""), ("german", "h", "0")])
def test_phonetic(lang, word, code):
    assert L[lang].phonetic(word) == code


def test_variants_and_compounds():
    assert L["english"].variants("apple") == ["apple", "app", "appl", "apples"]
    assert L["german"].split_compound("Krankenhaus") == ["kranken", "haus"]
    assert L["german"].split_compound("Haus") == ["Haus"]
    assert "walk" in L["english"].variants("walking")
    assert len(L["english"].variants("responsibility", "fast")) < len(L["english"].variants("responsibility", "comprehensive"))


def test_normalize():
    assert L["english"].normalize("  I CAN'T  won't you'd ") == "i cannot will not you would"
    assert L["german"].normalize("Straße Ärger") == "strasse aerger"
    assert L["spanish"].normalize("Niño") == "nino"
    assert L["french"].normalize("Garçon Élève") == "garcon eleve"


def test_registry_and_keyboards():
    assert [x.name for x in languages.get(["english", "klingon", "french"])] == ["english", "french"]
    assert languages.is_supported("german") and not languages.is_supported("klingon")
    assert languages.is_valid_substitution("english", "q", "w") and not languages.is_valid_substitution("english", "q", "p")
    assert "u" in languages.keyboard_neighbors("german", "z")
    assert len(languages.listed()) == 4


def test_config():
    assert config.merge()["scores"]["prefix"] == 0.97
    fast = config.merge({"performance": "fast", "scores": {"fuzzy": 0.5}})
    assert fast["max_results"] == 3 and fast["scores"]["fuzzy"] == 0.5 and fast["scores"]["prefix"] == 0.93
    assert config.merge({"languages": ["spanish"]})["features"] == config.LANGUAGE_FEATURES["spanish"]
    for bad in ({"max_results": 0}, {"fuzzy_threshold": 2}, {"ngram_size": 1}, {"languages": []}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            config.merge(bad)


@pytest.mark.parametrize(("a", "b", "d"), [("teh", "the", 1), ("ca", "abc", 2), ("", "abc", 3), ("recieve", "receive", 1), ("funciton", "function", 1), ("same", "same", 0)])
def test_damerau(a, b, d):
    assert distance.damerau(a, b) == d
    assert distance.damerau("kitten", "sitting", 2) == 3


def test_phrases():
    assert text.parse_phrases('"new york" city') == (["new york"], ["city"])
    assert text.parse_phrases('"" hello') == ([], ["hello"])
    assert text.parse_phrases('"a b c d e f g h i j k"')[0] == []
    assert text.parse_phrases("can't and won't")[0] == ["t and won"]


def test_json_strings():
    assert json_strings('{"a": ["x", 1, {"b": "y"}], "c": true}') == "x y"
    assert json_strings("not json") == "" and json_strings(None) == ""
    assert text.strip_accents("Straße café Łódź") == "Strasse cafe Lodz"
