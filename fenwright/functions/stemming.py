"""Stems of English (Porter's second algorithm) and German words, after the published Snowball definitions.

A language is a few ordered rule tables over the regions R1 and R2 of a word; words are lowered and hold no apostrophes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix tables and exceptions of the published algorithms.
EN_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
EN_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
EN_R1_HEADS = ("gener", "commun", "arsen")
EN_LONG = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
EN_MIDDLE = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_LAST = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
EN_LI_AFTER = "cdeghkmnrt"
DE_S_AFTER = "bdfghklmnrt"
DE_ST_AFTER = "bdfghklmnt"
UMLAUTS = str.maketrans("äöü", "aou")


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings) -> str:
    """The longest ending that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


_EN_VOWEL = "aeiouy"
_EN_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EN_WHOLE:
        return EN_WHOLE[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    head = next((len(h) for h in EN_R1_HEADS if w.startswith(h)), None)
    r1 = _region(w, _EN_VOWEL) if head is None else head
    r2 = _region(w, _EN_VOWEL, r1)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in EN_AFTER_PLURAL:
        return w

    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    stem = w[: len(w) - len(e)]
    if e.startswith("eed"):
        w = stem + "ee" if len(stem) >= r1 else w
    elif e and re.search(f"[{_EN_VOWEL}]", stem):
        if stem.endswith(("at", "bl", "iz")):
            w = stem + "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", stem):
            w = stem[:-1]
        else:
            w = stem + "e" if r1 >= len(stem) and _EN_SHORT.search(stem) else stem
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_VOWEL:
        w = w[:-1] + "i"

    for rules in (EN_LONG, EN_MIDDLE, EN_LAST):
        e = _ending(w, rules)
        stem = w[: len(w) - len(e)]
        region = r2 if rules is EN_LAST or e == "ative" else r1
        before = {"ogi": "l", "li": EN_LI_AFTER, "ion": "st"}.get(e)
        if e and len(stem) >= region and (before is None or stem[-1:] and stem[-1] in before):
            w = stem + rules[e]

    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _EN_SHORT.search(w[:-1])) or w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


_DE_VOWEL = "aeiouyäöü"


def german(word: str) -> str:
    w = re.sub(f"(?<=[{_DE_VOWEL}])[uy](?=[{_DE_VOWEL}])", lambda m: m[0].upper(), word.replace("ß", "ss"))
    first = _region(w, _DE_VOWEL)
    r1, r2 = max(first, min(3, len(w))), _region(w, _DE_VOWEL, first)

    e = _ending(w, ("em", "ern", "er", "e", "en", "es", "s"))
    stem = w[: len(w) - len(e)]
    if e and len(stem) >= r1 and (e != "s" or stem[-1:] and stem[-1] in DE_S_AFTER):
        w = stem[:-1] if e in ("e", "en", "es") and stem.endswith("niss") else stem

    e = _ending(w, ("en", "er", "est", "st"))
    stem = w[: len(w) - len(e)]
    if e and len(stem) >= r1 and (e != "st" or len(stem) > 3 and stem[-1] in DE_ST_AFTER):
        w = stem

    e = _ending(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    stem = w[: len(w) - len(e)]
    if e and len(stem) >= r2 and not (e in ("ig", "ik", "isch") and stem.endswith("e")):
        w = stem
        more = {"end": ("ig",), "ung": ("ig",), "lich": ("er", "en"), "heit": ("er", "en"), "keit": ("lich", "ig")}.get(e, ())
        inner = _ending(w, more)
        shorter = w[: len(w) - len(inner)]
        region = r1 if e in ("lich", "heit") else r2
        if inner and len(shorter) >= region and not (e in ("end", "ung") and shorter.endswith("e")):
            w = shorter
    return w.lower().translate(UMLAUTS)


LANGUAGES = {"english": english, "german": german}


def stem(word: str, language: str = "english") -> str:
    """The word itself for languages without a stemmer."""
    return LANGUAGES.get(language, str)(word)


def stems(tokens: Column, language: str = "english") -> Column:
    """Stems of an array of words, in Arrow batches; null for null. A task remembers at most 2**16 words."""
    rule = LANGUAGES.get(language)
    if rule is None:
        return tokens

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}

        def one(w):
            if w is None:
                return None
            s = known.get(w)
            if s is None:
                if len(known) >= 1 << 16:
                    known.clear()
                s = known[w] = rule(w)
            return s

        for b in batches:
            yield b.map(lambda words: None if words is None else [one(w) for w in words])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")(tokens)


def with_stem(tokens: Column, wanted: str, language: str = "english") -> Column:
    """The stems of those words that may have the wanted stem: a stem keeps its word's first letter, but for umlauts."""
    first = {wanted[:1], *[u for u in "äöü" if u.translate(UMLAUTS) == wanted[:1]]}
    return stems(F.filter(tokens, lambda x: F.substring(x, 1, 1).isin(*sorted(first))), language)
