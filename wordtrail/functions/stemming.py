"""Porter and Porter2 (English Snowball) stemming as column expressions.

Both follow the published rule tables. A word travels through the steps with its consonant ``y``
written as ``Y``, so every rule is a plain pattern: vowels are ``[aeiouy]``, all else consonants.
Meant for a distinct vocabulary; see :mod:`wordtrail.operators.stems`.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wordtrail.functions.arrays import let
from wordtrail.functions.hashing import _col

V, C = "[aeiouy]", "[^aeiouy]"
ONE = f"^{C}*{V}+{C}"
TWO = f"^{C}*{V}+{C}+{V}+{C}"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

# Irregular words of the first algorithm (as commonly extended).
PORTER_IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# Suffix tables of the first algorithm.
PORTER_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
PORTER_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
PORTER_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
                "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# Exceptions and suffix tables of the second algorithm.
PORTER2_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
PORTER2_KEPT = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
PORTER2_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive",
    "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
PORTER2_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
                 "ical": "ic", "ful": "", "ness": ""}
PORTER2_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
                 "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(word: Column | str) -> Column:
    """Porter's 1980 algorithm with its customary extensions."""
    lower = F.lower(_col(word))
    steps = [_mark_y, _porter_plural, _porter_past, _porter_y, _porter_alli,
             lambda w: _swap(w, PORTER_STEP2, ONE), _porter_logi, lambda w: _swap(w, PORTER_STEP3, ONE),
             _porter_residual, _porter_final]
    return _run(lower, steps, PORTER_IRREGULAR)


def _run(lower: Column, steps: list, irregular: dict[str, str]) -> Column:
    stem = lower
    for step in steps:
        stem = let(stem, step)
    known = F.create_map(*[F.lit(x) for pair in irregular.items() for x in pair])
    return (F.when(F.length(lower) <= 2, lower)
             .when(lower.isin(list(irregular)), F.try_element_at(known, lower))
             .otherwise(F.lower(stem)))


def _mark_y(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiou])y", "$1Y")


def _cut(word: Column, count: int) -> Column:
    """Word without its last ``count`` letters."""
    return F.substring(word, F.lit(1), F.length(word) - count)


def _parts(word: Column, suffixes: list[str]) -> Column:
    """``struct<stem, suffix>`` for the longest suffix found; empty suffix when none is."""
    pattern = "^(.*?)(" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$"
    return F.struct(F.regexp_extract(word, pattern, 1).alias("stem"),
                    F.regexp_extract(word, pattern, 2).alias("suffix"))


def _swap(word: Column, table: dict[str, str], condition: str) -> Column:
    """Replace the longest listed suffix when the stem before it meets the condition."""
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return let(_parts(word, list(table)), lambda p: F.when(
        (p.suffix != "") & p.stem.rlike(condition),
        F.concat(p.stem, F.try_element_at(mapping, p.suffix))).otherwise(word))


def _short_end(word: Column) -> Column:
    """consonant-vowel-consonant, the last not w, x or Y; or just vowel-consonant."""
    return word.rlike(f"{C}{V}[^aeiouywxY]$|^{V}{C}$")


def _porter_plural(w: Column) -> Column:
    return (F.when(w.endswith("sses"), _cut(w, 2))
             .when(w.endswith("ies"), F.when(F.length(w) == 4, _cut(w, 1)).otherwise(_cut(w, 2)))
             .when(w.endswith("ss"), w)
             .when(w.endswith("s"), _cut(w, 1)).otherwise(w))


def _porter_past(w: Column) -> Column:
    def repaired(stem: Column) -> Column:
        return (F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
                 .when(stem.rlike(DOUBLE), _cut(stem, 1))
                 .when(stem.rlike(ONE) & ~stem.rlike(TWO) & _short_end(stem), F.concat(stem, F.lit("e")))
                 .otherwise(stem))
    return (F.when(w.endswith("ied"), F.when(F.length(w) == 4, _cut(w, 1)).otherwise(_cut(w, 2)))
             .when(w.endswith("eed"), F.when(_cut(w, 3).rlike(ONE), _cut(w, 1)).otherwise(w))
             .when(w.endswith("ed") & _cut(w, 2).rlike(V), let(_cut(w, 2), repaired))
             .when(w.endswith("ing") & _cut(w, 3).rlike(V), let(_cut(w, 3), repaired))
             .otherwise(w))


def _porter_y(w: Column) -> Column:
    return F.when(w.rlike(f"..y$") & _cut(w, 1).rlike(f"{C}$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _porter_alli(w: Column) -> Column:
    return F.when(w.endswith("alli") & _cut(w, 4).rlike(ONE), _cut(w, 2)).otherwise(w)


def _porter_logi(w: Column) -> Column:
    return F.when(w.endswith("logi") & _cut(w, 3).rlike(ONE), _cut(w, 1)).otherwise(w)


def _porter_residual(w: Column) -> Column:
    return let(_parts(w, PORTER_STEP4), lambda p: F.when(
        (p.suffix != "") & p.stem.rlike(TWO) & ((p.suffix != "ion") | p.stem.rlike("[st]$")), p.stem).otherwise(w))


def _porter_final(w: Column) -> Column:
    def without_e(w: Column) -> Column:
        stem = _cut(w, 1)
        gone = stem.rlike(TWO) | (stem.rlike(ONE) & ~_short_end(stem))
        return F.when(w.endswith("e") & gone, stem).otherwise(w)
    return let(without_e(w), lambda w: F.when(
        w.endswith("ll") & _cut(w, 1).rlike(TWO), _cut(w, 1)).otherwise(w))


def porter2(word: Column | str) -> Column:
    """The English Snowball algorithm."""
    lower = F.regexp_replace(F.lower(_col(word)), "^'", "")
    steps = [_mark_y, lambda w: F.regexp_replace(w, "('s'|'s|')$", ""), _porter2_plural, _porter2_after_plural]
    return _run(lower, steps, PORTER2_IRREGULAR)


def _porter2_plural(w: Column) -> Column:
    return (F.when(w.endswith("sses"), _cut(w, 2))
             .when(w.rlike("(ied|ies)$"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
             .when(w.rlike("(us|ss)$"), w)
             .when(w.endswith("s") & _cut(w, 2).rlike(V), _cut(w, 1)).otherwise(w))


def _regions(w: Column) -> Column:
    """Start positions of R1 and R2; the word's end when a region is empty."""
    def second(p1: Column) -> Column:
        more = F.regexp_extract(F.substring(w, p1 + 1, F.length(w)), f"^{C}*{V}+{C}", 0)
        return F.struct(p1.alias("r1"),
                        F.when(more == "", F.length(w)).otherwise(p1 + F.length(more)).alias("r2"))
    head = F.regexp_extract(w, f"^(gener|commun|arsen|{C}*{V}+{C})", 1)
    return let(F.when(head == "", F.length(w)).otherwise(F.length(head)), second)


def _porter2_after_plural(w: Column) -> Column:
    def rest(regions: Column) -> Column:
        r1, r2 = regions.r1, regions.r2
        stem = w
        for step in [_porter2_past(r1), _porter2_y, _porter2_step2(r1), _porter2_step3(r1, r2),
                     _porter2_step4(r2), _porter2_final(r1, r2)]:
            stem = let(stem, step)
        return stem
    return F.when(w.isin(PORTER2_KEPT), w).otherwise(let(_regions(w), rest))


def _short_syllable(stem: Column) -> Column:
    return stem.rlike(f"{C}{V}[^aeiouywxY]$|^{V}{C}$")


def _porter2_past(r1: Column):
    def step(w: Column) -> Column:
        def repaired(stem: Column) -> Column:
            return (F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
                     .when(stem.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(stem, 1))
                     .when((F.length(stem) <= r1) & _short_syllable(stem), F.concat(stem, F.lit("e")))
                     .otherwise(stem))
        return let(_parts(w, ["eed", "eedly", "ed", "edly", "ing", "ingly"]), lambda p: (
            F.when(p.suffix == "", w)
             .when(p.suffix.isin("eed", "eedly"),
                   F.when(F.length(p.stem) >= r1, F.concat(p.stem, F.lit("ee"))).otherwise(w))
             .when(p.stem.rlike(V), let(p.stem, repaired)).otherwise(w)))
    return step


def _porter2_y(w: Column) -> Column:
    return F.when(w.rlike(f".{C}[yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _porter2_step2(r1: Column):
    table = F.create_map(*[F.lit(x) for pair in PORTER2_STEP2.items() for x in pair])

    def step(w: Column) -> Column:
        return let(_parts(w, [*PORTER2_STEP2, "ogi", "li"]), lambda p: (
            F.when((p.suffix == "") | (F.length(p.stem) < r1), w)
             .when(p.suffix == "ogi", F.when(p.stem.endswith("l"), _cut(w, 1)).otherwise(w))
             .when(p.suffix == "li", F.when(p.stem.rlike("[cdeghkmnrt]$"), p.stem).otherwise(w))
             .otherwise(F.concat(p.stem, F.try_element_at(table, p.suffix)))))
    return step


def _porter2_step3(r1: Column, r2: Column):
    table = F.create_map(*[F.lit(x) for pair in PORTER2_STEP3.items() for x in pair])

    def step(w: Column) -> Column:
        return let(_parts(w, [*PORTER2_STEP3, "ative"]), lambda p: (
            F.when((p.suffix == "") | (F.length(p.stem) < r1), w)
             .when(p.suffix == "ative", F.when(F.length(p.stem) >= r2, p.stem).otherwise(w))
             .otherwise(F.concat(p.stem, F.try_element_at(table, p.suffix)))))
    return step


def _porter2_step4(r2: Column):
    def step(w: Column) -> Column:
        return let(_parts(w, [*PORTER2_STEP4, "ion"]), lambda p: F.when(
            (p.suffix != "") & (F.length(p.stem) >= r2)
            & ((p.suffix != "ion") | p.stem.rlike("[st]$")), p.stem).otherwise(w))
    return step


def _porter2_final(r1: Column, r2: Column):
    def step(w: Column) -> Column:
        stem, size = _cut(w, 1), F.length(w) - 1
        no_e = (size >= r2) | ((size >= r1) & ~_short_syllable(stem))
        return (F.when(w.endswith("e") & no_e, stem)
                 .when(w.endswith("ll") & (size >= r2), stem).otherwise(w))
    return step
