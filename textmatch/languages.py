"""Languages: normalization, phonetic codes, variants, compounds, synonyms. Rules are data; small interpreters run them, on the JVM
where a column function can say it, else in Arrow-batched functions at index time."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the languages.
ENDINGS = {
    "base": "s es ed ing er est",
    "english": "s es ed ing er est ly tion sion ness ment able ible ful less ous ious al ial ic ive ary ery ory",
    "german": "en e er n r s es t ung heit keit schaft chen lein lich ig isch bar los voll",
    "spanish": "o a os as e es ar er ir ado ada idos idas ando endo iendo cion sion dad tad mente oso osa ito ita illo illa",
    "french": "e es s x ent ant ment tion sion eur euse teur trice able ible ique aire oire ette elle esse asse isse age isme iste ite ude ade",
}
COMPOUND_PREFIXES = "un vor nach bei mit ab an auf aus ein gegen hinter neben ueber unter zwischen selbst".split()
COMPOUND_SUFFIXES = "haus platz strasse weg hof berg tal feld stadt dorf heim werk bau anlage zentrum".split()
COMPOUND_WORDS = frozenset(
    "kranken kinder frauen maenner alt neu gross klein hoch tief lang kurz breit schmal dick duenn stark schwach schnell langsam heiss kalt warm auto bahn bus zug flug schiff rad motor wasser feuer erde "
    "luft licht schatten sonne mond tag nacht morgen abend mittag zeit jahr monat".split()
)
SYNONYMS = {
    "english": {
        "doctor": ["physician", "medic", "doc", "md"], "hospital": ["clinic", "medical center", "infirmary"], "school": ["academy", "institution", "college", "university"], "car": ["vehicle", "automobile", "auto"],
        "house": ["home", "residence", "dwelling", "building"], "street": ["road", "avenue", "lane", "boulevard"], "city": ["town", "municipality", "urban area"], "work": ["job", "employment", "occupation", "career"],
        "money": ["cash", "currency", "funds", "capital"], "time": ["duration", "period", "moment", "hour"], "big": ["large", "huge", "enormous", "massive", "giant"], "small": ["little", "tiny", "miniature", "petite"],
        "fast": ["quick", "rapid", "speedy", "swift"], "slow": ["sluggish", "gradual", "leisurely"], "good": ["excellent", "great", "wonderful", "fine"], "bad": ["poor", "terrible", "awful", "horrible"],
        "happy": ["joyful", "cheerful", "glad", "pleased"], "sad": ["unhappy", "depressed", "melancholy", "sorrowful"],
    },
    "german": {
        "arzt": ["doktor", "mediziner", "doc"], "krankenhaus": ["spital", "klinik", "hospital"], "schule": ["bildungseinrichtung", "lehranstalt"], "auto": ["wagen", "fahrzeug", "pkw"], "haus": ["gebaeude", "heim", "wohnhaus"],
        "strasse": ["weg", "gasse", "allee"], "stadt": ["ort", "gemeinde", "ortschaft"], "arbeit": ["job", "beruf", "taetigkeit"], "geld": ["waehrung", "kapital", "finanzen"], "zeit": ["dauer", "periode", "zeitraum"],
    },
    "spanish": {
        "medico": ["doctor", "facultativo"], "hospital": ["clinica", "sanatorio"], "escuela": ["colegio", "instituto"], "coche": ["auto", "automovil", "vehiculo"], "casa": ["hogar", "vivienda", "domicilio"],
        "calle": ["via", "avenida", "carretera"], "ciudad": ["urbe", "poblacion", "municipio"], "trabajo": ["empleo", "ocupacion", "labor"], "dinero": ["plata", "efectivo", "capital"], "tiempo": ["momento", "periodo", "duracion"],
        "grande": ["enorme", "gigante", "inmenso"], "pequeno": ["chico", "diminuto", "minusculo"], "rapido": ["veloz", "ligero", "acelerado"], "lento": ["despacio", "pausado"], "bueno": ["excelente", "magnifico", "estupendo"],
        "malo": ["pesimo", "terrible", "horrible"],
    },
    "french": {
        "medecin": ["docteur", "praticien"], "hopital": ["clinique", "centre medical"], "ecole": ["etablissement", "institution"], "voiture": ["automobile", "vehicule", "auto"], "maison": ["domicile", "residence", "habitation"],
        "rue": ["avenue", "boulevard", "voie"], "ville": ["cite", "commune", "agglomeration"], "travail": ["emploi", "occupation", "metier"], "argent": ["monnaie", "especes", "capital"], "temps": ["duree", "periode", "moment"],
        "grand": ["enorme", "immense", "gigantesque"], "petit": ["minuscule", "minime", "reduit"], "rapide": ["vite", "accelere", "prompt"], "lent": ["lentement", "doucement"], "bon": ["excellent", "parfait", "formidable"],
        "mauvais": ["terrible", "affreux", "horrible"], "heureux": ["joyeux", "content", "ravi"], "triste": ["malheureux", "chagrine", "melancolique"],
    },
}
#: Replacements after lower-casing, in order.
REPLACEMENTS = {
    "english": [("won't", "will not"), ("can't", "cannot"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am"), ("'", "")],
    "german": [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")],
    "spanish": list(zip("áéíóúñü", "aeiounu", strict=True)),
    "french": list(zip("àáâãäèéêëìíîïòóôõöùúûüçñÿ", "aaaaaeeeeiiiiooooouuuucny", strict=True)),
}
#: Phonetic codes. Each letter takes the first rule that matches at it; "~" is the letter itself in upper case.
CODES = {
    "english": [
        ("^[aeiou]", "~"), ("[aeiou]", ""), ("(?<=m)b$", ""), ("b", "B"), ("ch", "X"), ("c(?=[iey])", "S"), ("c", "K"), ("dg", "J"), ("d", "T"), ("f", "F"), ("(?!^)g(?=h)", ""), ("gn", "N"), ("g(?=[iey])", "J"), ("g", "K"),
        ("^h|(?<=[aeiou])h|h(?=[aeiou]|$)", "H"), ("h", ""), ("j", "J"), ("(?<=c)k", ""), ("k", "K"), ("l", "L"), ("m", "M"), ("n", "N"), ("ph", "F"), ("p", "P"), ("q", "K"), ("r", "R"), ("sh", "X"), ("s", "S"),
        ("th", "0"), ("t(?=i[ao])", "X"), ("t", "T"), ("v", "F"), ("w(?=[aeiou]|$)", "W"), ("w", ""), ("x", "KS"), ("y(?=[aeiou]|$)", "Y"), ("y", ""), ("z", "S"),
    ],
    "german": [
        ("[aeijouy]", "0"), ("[bp]", "1"), ("[dt](?=[csz])", "8"), ("[dt]", "2"), ("[fvw]", "3"), ("[gkq]", "4"), ("^c(?=[ahkloqrux])", "4"), ("^c", "8"), ("c(?=[hkq])", "4"), ("c", "8"), ("x", "48"), ("l", "5"), ("[mn]", "6"),
        ("r", "7"), ("[sz]", "8"),
    ],
    "spanish": [
        ("[aeiou]", "0"), ("[bvpw]", "1"), ("c(?=h)", "2"), ("c(?=[ei])", "8"), ("c", "4"), ("[dt]", "3"), ("f", "5"), ("g(?=u[ei])", "4"), ("g(?=[ei])", "6"), ("g", "4"), ("j", "6"), ("[kq]", "4"), ("l(?=l)", "7"), ("l", "5"),
        ("m", "6"), ("n(?=n)", "7"), ("n", "6"), ("^r|r(?=r)", "8"), ("r", "7"), ("[sz]", "8"), ("x", "48"), ("y", "7"),
    ],
    "french": [
        ("[aeiouy]", "0"), ("b", "1"), ("c(?=h)", "2"), ("c(?=[ei])", "8"), ("c", "4"), ("[dt]", "3"), ("f", "5"), ("g(?=n)", "6"), ("g(?=u[ei])", "4"), ("g(?=[ei])", "6"), ("g", "4"), ("^h", "0"), ("h", ""), ("j", "6"), ("[kq]", "4"),
        ("l", "5"), ("[mn]", "6"), ("p(?=h)", "5"), ("p", "1"), ("r", "7"), ("[sz]", "8"), ("[vw]", "5"), ("x", "48"),
    ],
}
_SOUNDEX = {c: d for letters, d in (("bfpv", "1"), ("cgjkqsxz", "2"), ("dt", "3"), ("l", "4"), ("mn", "5"), ("r", "6")) for c in letters}
_SPACES = re.compile(r"\s+")
#: Prefixes kept for words of up to 6, up to 12 and more letters.
BUDGET = {"fast": (2, 3, 4), "balanced": (2, 4, 6), "comprehensive": (3, 6, 8)}


@dataclass(frozen=True)
class Language:
    """Any object with these methods can take its place in the registry."""

    name: str
    title: str
    features: tuple[str, ...] = ("missing-letters", "extra-letters")
    replacements: tuple[tuple[str, str], ...] = ()
    codes: tuple[tuple[str, str], ...] = ()
    endings: tuple[str, ...] = field(default_factory=lambda: tuple(ENDINGS["base"].split()))
    synonyms: dict[str, list[str]] = field(default_factory=dict, hash=False)

    def normalize(self, text: str) -> str:
        text = _SPACES.sub(" ", text.lower().strip())
        for a, b in self.replacements:
            text = text.replace(a, b)
        return text

    def normalized(self, text: Column) -> Column:
        """normalize as a column expression."""
        text = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
        single = [(a, b) for a, b in self.replacements if len(a) == len(b) == 1]
        if single:
            text = F.translate(text, "".join(a for a, _ in single), "".join(b for _, b in single))
        for a, b in self.replacements:
            if (a, b) not in single:
                text = F.replace(text, F.lit(a), F.lit(b))
        return text

    @cached_property
    def _rules(self) -> re.Pattern:
        return re.compile("|".join(f"({p})" for p, _ in self.codes))

    def phonetic(self, word: str) -> str:
        text = self.normalize(word)
        if self.name == "english":
            text, out = re.sub("[^a-z]", "", text), ""
            at = 1 if re.match("gn|kn|pn|wr", text) else 0
            while at < len(text) and len(out) < 4:
                m = self._rules.match(text, at)
                code = self.codes[m.lastindex - 1][1]
                out, at = out + (m[0].upper() if code == "~" else code), m.end()
            return (out or "A") if text else ""
        if not self.codes:
            out = text[:1].upper()
            for c in text[1:]:
                if len(out) < 4 and (d := _SOUNDEX.get(c)) and d != out[-1]:
                    out += d
            return out.ljust(4, "0") if text else ""
        out, before = "", None
        for at in range(len(text)):
            if m := self._rules.match(text, at):
                code = self.codes[m.lastindex - 1][1]
                out += code if code != before else ""
                before = code
        return (out or "0") if text else ""

    def split_compound(self, word: str) -> list[str]:
        if self.name != "german":
            return word.split() if " " in word else [word]
        text = self.normalize(word)
        if len(text) < 6:
            return [word]
        for p in COMPOUND_PREFIXES:
            if text.startswith(p) and len(text) > len(p) + 3:
                return [p, *self.split_compound(text[len(p) :])]
        for s in COMPOUND_SUFFIXES:
            if text.endswith(s) and len(text) > len(s) + 3:
                return [*self.split_compound(text[: -len(s)]), s]
        for k in range(3, len(text) - 2):
            if text[:k] in COMPOUND_WORDS:
                return [text[:k], *self.split_compound(text[k:])]
        return [word]

    def variants(self, word: str, performance: str = "balanced") -> list[str]:
        """The normalized and the given word, stems, evenly spaced prefixes and the language's own forms, without repeats, in order."""
        text = self.normalize(word)
        out = dict.fromkeys([text, word])
        out |= dict.fromkeys(text[: -len(e)] for e in self.endings if text.endswith(e) and len(text) > len(e) + 2)
        if len(text) > 4:
            most = BUDGET.get(performance, BUDGET["balanced"])[0 if len(text) <= 6 else 1 if len(text) <= 12 else 2]
            for k in range(3, len(text), max(1, (len(text) - 3) // most)):
                out[text[:k]] = None
                if len(out) - 2 >= most:
                    break
        if self.name == "english":
            more = [text[:-1]] if text.endswith("s") and len(text) > 3 else []
            more += [text + "s"] if not text.endswith("s") else []
            for e, least in (("ing", 5), ("ed", 4)):
                if text.endswith(e) and len(text) > least:
                    more += [text[: -len(e)], text[: -len(e)] + "e"]
            out |= dict.fromkeys(more)
        if self.name == "german" and len(parts := self.split_compound(word)) > 1:
            out |= dict.fromkeys(self.normalize(p) for p in parts if len(p) >= 3)
        return list(out)

    def synonyms_of(self, word: str) -> list[str]:
        return self.synonyms.get(self.normalize(word), [])


def _built_in(name: str, title: str, features: str) -> Language:
    return Language(name, title, tuple(features.split()), tuple(REPLACEMENTS[name]), tuple(CODES[name]), tuple(ENDINGS[name].split()), SYNONYMS[name])


REGISTRY: dict[str, Language] = {
    lang.name: lang
    for lang in (
        _built_in("german", "Deutsch", "phonetic compound synonyms keyboard-neighbors partial-words missing-letters extra-letters"),
        _built_in("english", "English", "phonetic synonyms keyboard-neighbors partial-words missing-letters extra-letters transpositions"),
        _built_in("spanish", "Español", "phonetic synonyms keyboard-neighbors partial-words missing-letters extra-letters"),
        _built_in("french", "Français", "phonetic synonyms keyboard-neighbors partial-words missing-letters extra-letters"),
    )
}
#: Keyboard rows; neighbours are the keys beside, above and below.
KEYBOARDS = {"qwerty": ("qwertyuiop", "asdfghjkl", "zxcvbnm"), "qwertz": ("qwertzuiop", "asdfghjkl", "yxcvbnm"), "azerty": ("azertyuiop", "qsdfghjklm", "wxcvbn")}
LAYOUT = {"german": "qwertz", "french": "azerty"}


def keyboard_neighbors(language: str, key: str) -> set[str]:
    rows = KEYBOARDS[LAYOUT.get(language, "qwerty")]
    at = next(((r, row.index(key)) for r, row in enumerate(rows) if key in row), None)
    if at is None:
        return set()
    return {rows[r][c] for r in range(max(0, at[0] - 1), min(3, at[0] + 2)) for c in range(max(0, at[1] - 1), at[1] + 2) if c < len(rows[r])} - {key}


def is_valid_substitution(language: str, a: str, b: str) -> bool:
    return b.lower() in keyboard_neighbors(language, a.lower())


def get(names: list[str]) -> list[Language]:
    """Known languages of names, in order; unknown ones are left out."""
    return [REGISTRY[n] for n in names if n in REGISTRY]


def register(language: Language) -> None:
    REGISTRY[language.name] = language


def is_supported(name: str) -> bool:
    return name in REGISTRY


def listed() -> list[tuple[str, str, tuple[str, ...]]]:
    return [(x.name, x.title, x.features) for x in REGISTRY.values()]
