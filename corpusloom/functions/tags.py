"""What the places of a morphological tag say, in English and Romanian."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("en", "ro")
# Names of attributes and of their values by letter, English and Romanian.
_PERSON = ("Person", "Persoana", {"1": ("first", "întâi"), "2": ("second", "a doua"), "3": ("third", "a treia")})
_NUMBER = ("Number", "Număr", {"s": ("singular", "singular"), "p": ("plural", "plural")})
_GENDER = ("Gender", "Gen", {"f": ("feminine", "feminin"), "m": ("masculine", "masculin")})
_GENDERS = ("Gender", "Gen", {**_GENDER[2], "n": ("neuter", "neutru")})
_CASE = ("Case", "Caz", {"r": ("direct", "direct"), "o": ("oblique", "oblic")})
_VOCATIVE = {"v": ("vocative", "vocativ")}
_CASES = ("Case", "Caz", {**_CASE[2], **_VOCATIVE})
_DEFINITE = ("Definiteness", "Articol", {"y": ("yes", "hotărât"), "n": ("no", "nehotărât")})
_CLITIC = ("Clitic", "Clitic", {"y": ("yes", "da"), "n": ("no", "nu")})
_MOOD = ("Mood", "Mod", {"i": ("indicative", "indicativ"), "n": ("infinitive", "infinitiv"), "s": ("conjunctive", "conjunctiv"),
                         "m": ("imperative", "imperativ"), "p": ("participle", "participiu"), "g": ("gerund", "gerunziu")})
_TENSE = ("Tense", "Timp", {"p": ("present", "prezent"), "i": ("imperfect", "imperfect"), "s": ("past", "perfect simplu"), "l": ("long", "mai mult ca perfectul")})
_FORM = ("Form", "Formă", {"l": ("letter", "literală"), "d": ("digit", "digitală"), "r": ("roman", "romană")})
_PLACE = ("Positioning", "Poziționare", {"e": ("prenominal", "prenominală"), "o": ("postnominal", "postnominală")})
_SHARED = {"d": ("demonstrative", "demonstrativ"), "i": ("indefinite", "nehotărât"), "s": ("possessive", "posesiv")}
_PRONOUNS = {**_SHARED, "w": ("relative", "relativ"), "z": ("negative", "negativ")}


def _type(values: dict[str, tuple[str, str]]) -> tuple[str, str, dict[str, tuple[str, str]]]:
    return "Type", "Tip", values


#: For each first letter its names, and the attribute at each place (counted from 0).
LAYOUT = {
    "V": ("VERB", "Verb", [(1, _type({"m": ("predicative", "predicativ"), "a": ("auxiliary", "auxiliar")})), (2, _MOOD), (3, _TENSE), (4, _PERSON), (5, _NUMBER), (10, _CLITIC)]),
    "A": ("ADJECTIVE", "Adjectiv", [(3, _GENDER), (4, _NUMBER), (5, _CASE), (5, ("Caz", "Caz", _VOCATIVE)), (6, _DEFINITE), (7, _CLITIC)]),
    "N": ("NOUN", "Substantiv", [(1, _type({"c": ("common", "comun"), "p": ("proper", "propriu")})), (2, _GENDER), (3, _NUMBER), (4, _CASES), (5, _DEFINITE), (6, _CLITIC)]),
    "P": ("PRONOUN", "Pronume", [(1, _type({**_PRONOUNS, "p": ("personal", "personal"), "x": ("reflexive", "reflexiv"), "h": ("intensive", "emfatic")})), (2, _PERSON), (3, _GENDER), (4, _NUMBER),
          (5, _CASES), (6, ("Possesor_Number", "Numarul_posesorului", _NUMBER[2])), (7, ("Possesor_Gender", "Genul_posesorului", _GENDER[2]))]),
    "D": ("DETERMINER", "Adjectiv pronominal", [(1, _type({**_PRONOUNS, "h": ("emfatic", "emfatic")})), (2, _PERSON), (3, _GENDERS), (4, _NUMBER), (5, _CASE),
          (6, ("Possessor_number", "Numărul_posesorului", _NUMBER[2])), (7, ("Possessor_gender", "Genul_posesorului", _GENDER[2])), (9, _PLACE)]),
    "T": ("ARTICLE", "Articol", [(1, _type({**_SHARED, "f": ("definite", "hotărât")})), (2, _GENDERS), (3, _NUMBER), (4, _CASES), (5, _CLITIC)]),
    "R": ("ADVERB", "Adverb", [(3, _CLITIC)]),
    "S": ("ADPOSITION", "Prepoziție", [(4, _CLITIC)]),
    "C": ("CONJUNCTION", "Conjuncție", [(1, _type({"c": ("coordinating", "coordonatoare"), "p": ("subordinating", "subordonatoare")})), (5, _CLITIC)]),
    "M": ("NUMERAL", "Numeral", [(1, _type({"c": ("cardinal", "cardinal"), "o": ("ordinal", "ordinal"), "f": ("fractional", "fracțional"), "m": ("multiplicative", "multiplicativ")})),
          (2, _GENDERS), (3, _NUMBER), (4, _CASES), (5, _FORM), (6, _DEFINITE), (7, _CLITIC)]),
    "I": ("INTERJECTION", "Interjecție", []),
    "X": ("SYMBOL/FOREIGN", "simbol/cuvânt străin", []),
    "Y": ("ABBREVIATION", "Abreviere", []),
    "Q": ("PARTICLE", "Particulă", [(1, _type({"z": ("negative", "negativă"), "n": ("infinitive", "de infinitiv"), "s": ("conjunctive", "de conjunctiv"), "f": ("future", "de viitor")})), (3, _CLITIC)]),
}


#: A tag that tells more than itself has nothing or a lower-case letter at its second place.
TELLING = r"\A.(?:\z|\p{Ll})"


def _value(tag: Column, place: int, values: dict[str, tuple[str, str]], at: int) -> Column:
    held = F.create_map(*(F.lit(x) for letter, names in values.items() for x in (letter, names[at])))
    return F.try_element_at(held, F.substr(tag, F.lit(place + 1), F.lit(1)))


def attributes(tag: Column, letter: str, language: str = "en") -> dict[str, Column]:
    """By name what a tag that begins with ``letter`` says, nulls where it says nothing; of a name for two lists of values the one that has the place's letter."""
    at = LANGUAGES.index(language)
    *names, places = LAYOUT[letter]
    out = {"POS": F.lit(names[at])}
    for place, slot in places:
        value = _value(tag, place, slot[2], at)
        out[slot[at]] = F.coalesce(out[slot[at]], value) if slot[at] in out else value
    return out


def described(tag: Column, language: str = "en") -> Column:
    """A map of what a tag says, keys in order; only ``MSD``, the tag itself, where its second place is no lower-case letter or its first one is unknown.

    Places that say nothing are left out; a null tag gives null.
    """
    at = LANGUAGES.index(language)
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))

    own = F.array(entry("MSD", tag))
    said = F.lit(None)
    for letter, (*names, places) in LAYOUT.items():
        told = F.array(entry("MSD", tag), entry("POS", F.lit(names[at])), *(entry(slot[at], _value(tag, place, slot[2], at)) for place, slot in places))
        said = F.when(tag.startswith(letter), told).otherwise(said)
    whole = F.coalesce(F.when(tag.rlike(TELLING), said), own)
    return F.when(tag.isNotNull(), F.map_from_entries(F.array_sort(F.filter(whole, lambda e: e["value"].isNotNull()))))
