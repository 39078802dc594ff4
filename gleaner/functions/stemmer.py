"""Porter's stemmer ("An algorithm for suffix stripping", 1980) for columns of words, and its SQL twin.

Every step is a list of suffixes; the longest that a word ends in decides, and it is replaced if what stands before it fits
the step's condition. Words of other letters than a to z and of one or two letters stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Conditions on a stem: measure over 0, of 1, over 1; a vowel; consonant, vowel, consonant (not w, x, y) at the end.
_OVER_0, _IS_1, _OVER_1 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL, _CVC = f"^({_C})?{_V}", f"^{_C}[aeiouy][^aeiouwxy]$"

#: The suffixes of the steps and what they become.
_PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
_STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP_4 = tuple((s, "") for s in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split())
#: English words that no channel looks for.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who "
    "whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def _by_length(rules: tuple) -> list:
    return sorted(rules, key=lambda r: -len(r[0]))


def _step(w: str, rules: list, condition: re.Pattern | None) -> str:
    for suffix, new in rules:
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            fits = condition is None or (condition.search(stem) and (suffix != "ion" or stem[-1:] in ("s", "t")))
            return stem + new if fits else w
    return w


_over_0, _is_1, _over_1, _vowel, _cvc = map(re.compile, (_OVER_0, _IS_1, _OVER_1, _VOWEL, _CVC))
_steps = ((_by_length(_STEP_2), _over_0), (_by_length(_STEP_3), _over_0), (_by_length(_STEP_4), _over_1))
_plurals = _by_length(_PLURALS)
_plain = re.compile("[a-z]{3,}").fullmatch


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if not _plain(word):
        return word
    w = "Y" + word[1:] if word[0] == "y" else word  # a first y is a consonant
    w = _step(w, _plurals, None)
    if w.endswith("eed"):
        w = w[:-1] if _over_0.search(w[:-3]) else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                b = w[: -len(suffix)]
                if _vowel.search(b):
                    if b.endswith(("at", "bl", "iz")) or not (len(b) > 1 and b[-1] == b[-2] and b[-1] not in "aeiouylsz") and _is_1.search(b) and _cvc.search(b):
                        w = b + "e"
                    else:
                        w = b[:-1] if len(b) > 1 and b[-1] == b[-2] and b[-1] not in "aeiouylsz" else b
                break
    if w.endswith("y") and _vowel.search(w[:-1]):
        w = w[:-1] + "i"
    for rules, condition in _steps:
        w = _step(w, rules, condition)
    if w.endswith("e") and (_over_1.search(w[:-1]) or (_is_1.search(w[:-1]) and not _cvc.search(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _over_1.search(w):
        w = w[:-1]
    return w.lower()


def stemmed(words: DataFrame, word: str = "term", name: str = "stem") -> DataFrame:
    """``words`` with the stem of a column of lower-case words: one Arrow pass over what should be distinct words."""
    at = words.columns.index(word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stems = pa.array([None if w is None else stem(w) for w in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, stems], names=[*b.schema.names, name])

    return words.mapInArrow(run, T.StructType([*words.schema.fields, T.StructField(name, T.StringType())]))


def stem_sql(source: str, word: str = "term", name: str = "stem") -> str:
    """A query that gives the rows of ``source`` (a name) with their stem."""
    cut = lambda k: f"substr(w, 1, length(w) - {k})"
    fits = lambda k, c: f"regexp_matches({cut(k)}, '{c}')"

    def step(rules: tuple, condition: str | None) -> str:
        cases = []
        for suffix, new in _by_length(rules):
            k = len(suffix)
            test = "true" if condition is None else fits(k, condition) + (f" AND regexp_matches({cut(3)}, '[st]$')" if suffix == "ion" else "")
            cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {test} THEN {cut(k)} || '{new}' ELSE w END")
        return "CASE " + " ".join(cases) + " ELSE w END"

    bare = f"CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND {fits(2, _VOWEL)} THEN {cut(2)} WHEN ends_with(w, 'ing') AND {fits(3, _VOWEL)} THEN {cut(3)} END"
    mended = (
        f"CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '[^aeiouylsz]$') AND length(b) > 1 AND substr(b, length(b), 1) = substr(b, length(b) - 1, 1) THEN substr(b, 1, length(b) - 1) "
        f"WHEN regexp_matches(b, '{_IS_1}') AND regexp_matches(b, '{_CVC}') THEN b || 'e' ELSE b END"
    )
    q = f"SELECT *, regexp_replace({word}, '^y', 'Y') AS w FROM {source}"
    for w in (
        step(_PLURALS, None), None, f"CASE WHEN ends_with(w, 'y') AND {fits(1, _VOWEL)} THEN {cut(1)} || 'i' ELSE w END", step(_STEP_2, _OVER_0), step(_STEP_3, _OVER_0), step(_STEP_4, _OVER_1),
        f"CASE WHEN ends_with(w, 'e') AND ({fits(1, _OVER_1)} OR ({fits(1, _IS_1)} AND NOT {fits(1, _CVC)})) THEN {cut(1)} ELSE w END", f"CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{_OVER_1}') THEN {cut(1)} ELSE w END",
    ):
        if w is None:
            q = f"SELECT * EXCLUDE (b) REPLACE (coalesce({mended}, CASE WHEN ends_with(w, 'eed') AND {fits(3, _OVER_0)} THEN {cut(1)} ELSE w END) AS w) FROM (SELECT *, {bare} AS b FROM ({q}))"
        else:
            q = f"SELECT * REPLACE ({w} AS w) FROM ({q})"
    return f"SELECT * EXCLUDE (w), CASE WHEN regexp_matches({word}, '^[a-z]{{3,}}$') THEN lower(w) ELSE {word} END AS {name} FROM ({q})"
