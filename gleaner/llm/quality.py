"""Quality rules: fixed base rules, then line-sequence labelling by a linear-chain CRF.

A document's lines are a sequence; each line with a word gets binary features (symbols,
capitals, separators, repetition, length, ...). The CRF is trained on the lines of a bounded
sample of labelled documents (``labels.quality``; every line takes its document's label),
Viterbi marks each line content or boilerplate, and the share of the word characters that
stand in content lines decides whether the document stays.

Defined cases: null and empty texts have no words, fail the base rules and are not kept.
A null doc_id, repeated rows and extra columns pass through; each row is judged by itself.
Without labelled rows every line counts as content, so the base rules alone decide. The pipeline stage
trains on the labelled rows of ``documents``, not on those of its input. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, keep, small_batches, table
from .crf import Crf, all_content, fit

#: Labelled documents the CRF is fitted on at most and the longest such text; all their lines count, in runs of so many.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_RUN = 1000, 20_000, 48
#: Least share of word characters in content lines for a document to stay.
CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"

_word = re.compile(WORD)
#: Features: for each measure its number of bins (see _line_features), then single flags.
_EDGES = {
    "symbols": (0.001, 0.03, 0.1, 0.2),
    "upper": (0.001, 0.1, 0.3, 0.7),
    "digits": (0.001, 0.05, 0.2),
    "bangs": (0.001, 0.02, 0.08),
    "pipes": (0.001, 0.02, 0.08),
    "words": (2, 5, 13, 41),
    "word_length": (2.5, 4.5, 7.0, 10.0),
    "distinct": (0.2, 0.5, 0.8, 0.97),
    "stops": (0.001, 0.05, 0.15),
    "top_word": (0.1, 0.25, 0.5, 0.8),
}
_WIDTH = len(_EDGES) + 3
_OFFSETS = dict(zip(_EDGES, np.cumsum([0] + [len(e) + 1 for e in _EDGES.values()])))
_FLAGS = sum(len(e) + 1 for e in _EDGES.values())
N_FEATURES = _FLAGS + 4  # bias, repeated line, link, full stop


def base_counts(text: str) -> tuple[int, int, int, int, int, list[str]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words themselves."""
    words = _word.findall(text)
    n = len(words)
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += bool(_word.search(line))
        else:
            seen.add(line)
    repeats = 0
    if n >= 3:
        first: dict[tuple, int] = {}
        marked = bytearray(n)
        for i, key in enumerate(zip(words, words[1:], words[2:])):
            j = first.setdefault(key, i)
            if j != i:
                marked[i] = marked[i + 1] = marked[i + 2] = 1
                marked[j] = marked[j + 1] = marked[j + 2] = 1
        repeats = sum(marked)
    return n, sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), dups, repeats, words


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Active features ``[lines, width]`` and word characters of each line that has a word."""
    lines = [x for x in text.split("\n") if _word.search(x)]
    if not lines:
        return np.zeros((0, _WIDTH), np.int32), np.zeros(0, np.int64)
    joined = "\n".join(lines)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    at = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))

    def count(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), at)

    blank = ((c >= 9) & (c <= 13)) | (c == 32)
    chars = np.maximum(count(~blank), 1)
    pipes = c == 124
    measures = {
        "symbols": count((c == 35) | (c == 42) | (c == 36) | (c == 37) | (c == 38) | pipes | (c == 60) | (c == 62)) / chars,
        "upper": count(((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7))) / chars,
        "digits": count((c >= 48) & (c <= 57)) / chars,
        "bangs": count(c == 33) / chars,
        "pipes": count(pipes) / chars,
    }
    seen: set[str] = set()
    n_words, distinct, stops, top, flags = [], [], [], [], []
    for line in lines:
        words = _word.findall(line)
        n, kinds = len(words), set(words)
        n_words.append(n)
        distinct.append(len(kinds) / n)
        stops.append((line.count(".") + line.count(",")) / n)
        top.append(words.count(words[0]) / n if n > 4 else 0.0)
        flags.append((_FLAGS + 1 if line in seen else N_FEATURES, _FLAGS + 2 if "http" in line or "www." in line else N_FEATURES))
        seen.add(line)
    counts = np.array(n_words)
    measures |= {"words": counts, "word_length": chars / counts, "distinct": np.array(distinct), "stops": np.array(stops), "top_word": np.array(top)}
    feats = np.empty((len(lines), _WIDTH), np.int32)
    for i, (name, edges) in enumerate(_EDGES.items()):
        feats[:, i] = _OFFSETS[name] + np.searchsorted(edges, measures[name], side="right")
    feats[:, -3] = _FLAGS
    feats[:, -2:] = flags
    return feats, chars


def content_share(model: Crf, text: str) -> float:
    """Share of word characters in the lines that Viterbi marks as content (1 without lines)."""
    feats, chars = line_features(text)
    if not len(chars):
        return 1.0
    return float(chars[model.decode(feats) == 1].sum() / chars.sum())


def train(docs: DataFrame, labels: DataFrame) -> Crf:
    """Fit the CRF on at most TRAIN_DOCS labelled documents, those with the smallest hashes.

    The features are built by Spark tasks; the driver gets those of the lines of TRAIN_DOCS texts at
    most, none over TRAIN_CHARS characters.
    """
    marked = (
        labels.select("doc_id", F.col("quality").cast("int").alias("_q"))
        .where("doc_id is not null and _q in (0, 1)")
        .groupBy("doc_id").agg(F.max("_q").alias("_q"))
    )
    # the sample is drawn from the labels, so only its texts, not all labelled ones, are moved
    chosen = marked.withColumn("_h", F.xxhash64(F.lit(6), "doc_id")).orderBy("_h", "doc_id").limit(TRAIN_DOCS)
    sample = (
        docs.select("doc_id", "text")
        .where(F.length("text").between(1, TRAIN_CHARS))
        .join(F.broadcast(chosen), "doc_id")  # at most TRAIN_DOCS rows
        .orderBy("_h", "doc_id", "text").limit(TRAIN_DOCS)
        .select("text", "_q")
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, marks = [], []
            for text, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = line_features(text)[0]
                for at in range(0, len(f), TRAIN_RUN):
                    rows.append(f[at : at + TRAIN_RUN].astype("<i4").tobytes())
                    marks.append(q)
            yield pa.record_batch({"f": pa.array(rows, pa.binary()), "q": pa.array(marks, pa.int32())})

    got = sample.mapInArrow(build, "f binary, q int").collect()
    seqs = [np.frombuffer(r.f, "<i4").reshape(-1, _WIDTH) for r in got]
    if not seqs:
        return all_content(N_FEATURES)
    return fit(seqs, [np.full(len(s), r.q, np.int8) for s, r in zip(seqs, got)], N_FEATURES)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(docs: DataFrame, model: Crf, share: float = CONTENT_SHARE) -> DataFrame:
    """One row per document: base counts, base verdict, content share and whether it stays."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("quality", None, dict)  # lets go of what other operators kept
        crf = shared.value
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                n, chars, symbols, dups, repeats, _ = base_counts(text)
                failed = base_failed(n, repeats)
                part = content_share(crf, text)
                rows.append((doc_id, n, chars, symbols, dups, repeats, failed, not failed and part >= share, part))
            yield pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, pa.int64()) for i, x in enumerate(zip(*rows))], names=_NAMES) if rows else _empty()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _empty() -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([], kinds[x.split()[1]]) for x in SCHEMA.split(", ")], names=_NAMES)


def keep_good(docs: DataFrame, model: Crf, share: float = CONTENT_SHARE) -> DataFrame:
    """The documents that stay, with all their columns: one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("quality", None, dict)  # lets go of what other operators kept
        crf = shared.value
        for b in batches:
            good = []
            for text in b.column(at).to_pylist():
                text = text or ""
                words = base_counts(text)
                good.append(not base_failed(words[0], words[4]) and content_share(crf, text) >= share)
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    small_batches(spark)
    return keep_good(docs, train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
