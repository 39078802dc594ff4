"""Answers in boxes, and their comparison with references: a scanner of balanced braces as a fold over letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .unicode import normalized

#: What evaluators are called, and the signs that part phrases unless one names others.
PHRASES, CHOICES, JUDGES = ("norm_phrase_set_match", "norm_phrase_set_match_ordered"), ("mc_choice_match", "mc_choice_set_match"), {"llm_abstention_checker": "abstention", "llm_gotchas_checker": "gotchas"}
SEPARATORS = ",;"
_BETWEEN = "\u0001"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def boxed(text: Column) -> Column:
    """What stands in the last ``\\boxed{...}`` of a text, its braces balanced; the whole text without one, where it is not closed, or where it is empty."""
    parts = F.split(text, r"\\boxed\{")
    tail = F.element_at(parts, -1)

    def scan(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        end = F.when((s["end"] == 0) & (depth == 0), s["at"]).otherwise(s["end"])
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), end.alias("end"))

    start = F.struct(F.lit(1).alias("depth"), F.lit(1).alias("at"), F.lit(0).alias("end"))
    end = F.aggregate(F.split(tail, ""), start, scan, lambda s: s["end"])
    inside = _trimmed(F.substring(tail, F.lit(1), end - 1))
    return F.when((F.size(parts) > 1) & (end > 0) & (inside != ""), inside).otherwise(_trimmed(text))


def is_unknown(text: Column) -> Column:
    return F.lower(boxed(text)) == "unknown"


def phrase(text: Column) -> Column:
    """A phrase as it is compared: compatibility forms, lower case, hyphens, punctuation and symbols as spaces."""
    bare = F.regexp_replace(F.lower(text), r"[‐‑‒–—―\p{P}\p{S}-]", " ")
    return F.trim(F.regexp_replace(bare, r"[\s\p{Z}]+", " "))


def _parted(text: Column, evaluator: Column) -> Column:
    """The phrases of a boxed answer as they stand, with a sign between them that no text has."""
    named = F.regexp_extract(evaluator, r"(?:^|\|)separators=([^|]+)", 1)
    signs = F.regexp_replace(F.when(named == "", SEPARATORS).otherwise(named), r"([^\p{L}\p{N}\s])", r"\\$1")
    return F.array_join(F.split(boxed(text), F.concat(F.lit("["), signs, F.lit("]"))), _BETWEEN)


def _phrases(parted: str) -> Column:
    return F.filter(F.transform(F.split(parted, _BETWEEN), phrase), lambda p: p != "")


def choices(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(boxed(text)), F.lit(r"(?<![A-Za-z0-9_])([A-H])(?![A-Za-z0-9_])"), 1)


def evaluated(rows: DataFrame, prediction: str = "prediction", reference: str = "reference", evaluator: str = "evaluator") -> DataFrame:
    """``rows`` with ``correct``, whether the answer equals the reference by its evaluator, and ``judge``, the kind of judge that has to say where that is null.

    Sets are compared in any order, ordered phrases and single choices as they stand; an empty answer is wrong. An evaluator of
    another name is an error.
    """
    said, wanted, by = F.col(prediction), F.col(reference), F.col(evaluator)
    parted = rows.withColumn("_p", _parted(said, by)).withColumn("_r", _parted(wanted, by))
    parted = normalized(normalized(parted, "_p"), "_r")
    kind = F.split(by, r"\|")[0]
    same = lambda p, r, any_order: (F.size(p) > 0) & F.when(any_order, F.array_sort(p) == F.array_sort(r)).otherwise(p == r)
    judge = F.create_map(*(F.lit(x) for kv in JUDGES.items() for x in kv))[kind]
    correct = (
        F.when(kind.isin(*PHRASES), same(_phrases("_p"), _phrases("_r"), kind == PHRASES[0])).when(kind.isin(*CHOICES), same(choices(said), choices(wanted), kind == CHOICES[1]))
        .when(kind.isin(*JUDGES), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("unsupported evaluator "), kind)).cast("boolean"))
    )
    return parted.withColumn("correct", correct).withColumn("judge", judge).drop("_p", "_r")
