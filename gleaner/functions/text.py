"""Text analysis as column expressions: terms, aliases, CJK grams, answer normalisation, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no alias by themselves.
ALIAS_STOPS = (
    "a an are at can could did do does for from had has have how in is may might of on should that the these this those to was were what when where "
    "which who whom whose why will would"
).split()
#: Words that may join two capitalised words of one alias.
CONNECTORS = "of|the|and|for|de|da|del|van|von|la|le"
_NAME = r"\p{Lu}[\p{L}\p{N}_.'’:-]*"


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits (with inner marks), in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}_'-]*)"), 1)


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def aliases(text: Column, most: int = 64) -> Column:
    """Entity aliases: quoted spans, capitalised names, tokens with a digit; most words, longest and smallest first."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r'"([^"\p{Cntrl}]{2,128})"'), 1),
        F.regexp_extract_all(text, F.lit(rf"({_NAME}(?:\s+(?:(?:{CONNECTORS})\s+)?{_NAME})*)"), 1),
        F.regexp_extract_all(text, F.lit(r"(\p{Lu}[\p{L}\p{N}_.'’:-]+)"), 1),
        F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_./:#-]*\p{N}[\p{L}\p{N}_./:#-]*)"), 1),
    )
    tidy = F.transform(found, lambda a: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(a), r"\s+", " "), r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")))
    good = F.array_distinct(F.filter(tidy, lambda a: F.length(a).between(2, 128) & a.rlike(r"\p{L}") & ~a.isin(*ALIAS_STOPS)))
    # negative counts first, then the text: an ascending sort of structs
    keyed = F.transform(good, lambda a: F.struct((-F.size(F.split(a, r"\s+"))).alias("words"), (-F.length(a)).alias("size"), a.alias("alias")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda k: k["alias"])


_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"


def cjk_grams(text: Column, size: int = 3, most: int = 24) -> Column:
    """Distinct code-point grams of the text's CJK runs; a run of two is kept whole."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(rf"([{_CJK}ー々ゝゞヽヾ]+)"), 1), lambda r: F.length(r) >= 2)
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - size + 1)), lambda i: F.substring(r, i, F.lit(size)))))
    return F.slice(F.array_distinct(grams), 1, most)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: str, b: str, norm_a: str, norm_b: str) -> Column:
    """1 - cosine of two arrays whose norms are columns; null where a norm is 0."""
    return 1 - F.try_divide(dot(a, b), F.col(norm_a) * F.col(norm_b))


def normalized_answer(text: Column) -> Column:
    """Lower case without commas, ASCII punctuation and articles, single spaces."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, ",", "")), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?<![A-Za-z0-9_])(a|an|the|and)(?![A-Za-z0-9_])", " "), r"\s+", " "))


def line_at(text: Column, position: Column) -> Column:
    """The 1-based line that the code point after ``position`` others stands in."""
    head = F.substring(text, F.lit(1), position.cast("int"))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def blob_outcome(content: Column, most: int, supported: Column) -> Column:
    """How an index takes a blob (binary): indexed, or excluded and why."""
    return (
        F.when(F.octet_length(content) == 0, "excluded:empty").when(F.instr(F.hex(content), "00") % 2 == 1, "excluded:binary")
        .when(~F.is_valid_utf8(content.cast("string")), "excluded:invalid_utf8").when(F.octet_length(content) > most, "excluded:oversized").when(~supported, "excluded:unsupported").otherwise("indexed")
    )


def documents_in(text: Column) -> Column:
    """The documents that a text holds behind markers ``Document n:``, with their markers; what stands before the first is one too."""
    mark = "\u0001"
    return F.filter(F.split(F.regexp_replace(text, r"(Document \d+:)", f"{mark}$1"), mark), lambda p: p != "")
