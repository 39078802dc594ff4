"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

A text's sentences (in windows of at most WINDOW_WORDS words) are compared with landmark words by a gap-weighted subsequence
kernel: for two words it sums, over all ordered letter triples that both hold within a span of
SPAN letters, DECAY to the power of the spans, normalised to a cosine and raised to POWER (values under FAINT are
zero), so that chance overlaps fade. Marks of a word's start and end are letters like others, so beginnings and endings count as such. A sentence's kernel value with a landmark is the sum over its distinct words. Gaps cost
little, so an insult with inserted characters, doubled letters or look-alike digits stays close to the
plain one; runs of single letters ("i d i o t") are read as one word. Words of more than WHOLE letters (glued, letter-spaced
or without white space) count by their highest letter window: for each length of a landmark windows of a
quarter more letters run over the whole word and overlap by that length.

The kernel's Gram matrix K of the landmarks gives the Nyström features K^(-1/2) k(x); a linear SVM (squared hinge)
is trained on them over labelled sentences. Sentences take their document's label, and
since most sentences of a toxic document are harmless, training is repeated with each toxic document's
highest-scoring sentences only (multiple-instance learning). Then ALTERED copies of each toxic document's worst
sentence join the training, its worst word with letters put in, left out, swapped, doubled or glued on, so that
the SVM sets its boundary where such words still count. Because the decision is linear
in k(x), each word has a fixed contribution, computed in numpy for batches of new words
and remembered; a document's score is a logistic curve, fitted on the training documents weighted to
the labels' shares, of its highest sentence and its highest passage (sentences in a row of PASSAGE words):
one word tells less than several close together.

Landmarks are words of the letter groups that cover the toxic documents, each language's among them, taken greedily by the log ratio of
their shares; after a first fit the words of clean documents that look most like insults join them, and the model is
fitted again. No significance test and no size switches anything.

Landmarks and the SVM are fitted on a bounded sample of labelled documents (TRAIN_TOXIC,
TRAIN_CLEAN, those with the smallest hashes among texts of at most TRAIN_CHARS characters) outside the held-out quarter. Only texts are inputs.

Defined cases: null and empty texts have no sentence and get the curve's value at the bias alone; without
both labels in training every score is 0 (with both there is always a model); null or repeated doc_ids are scored row by row; labels that are null
are ignored, repeated ones count as toxic if any is; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, small_batches, table

#: Labelled documents that the model is fitted on at most, and the longest text among them.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1000, 1500, 20_000
#: Landmarks at most, and words of one letter group among them.
LANDMARKS, PER_GROUP = 128, 4
#: Letters of a group, marks included; how often a toxic document is to be covered; the least log ratio of a group's shares, less its standard error.
GROUP, COVER, LEAST = (4, 7), 10, 0.5
#: Words of clean documents that join the landmarks at most, and the contribution that makes one a false alarm.
ALARMS, ALARM = 64, 0.1
SPAN, DECAY, POWER = 6, 0.8, 2
#: Kernel values (before POWER) under this are taken as zero.
FAINT = 0.35
#: Altered copies of a toxic sentence's worst word that training adds.
ALTERED = 4
WINDOW_WORDS, PASSAGE = 30, 200
#: Words of more letters are compared in letter windows.
WHOLE = 18
THRESHOLD = 0.3
HELD_OUT = 2
#: Words that a Python worker remembers at most, and the longest that it keeps after their batch.
MEMO, LONGEST_KEPT = 1 << 19, 64
LETTERS = 64  # classes of letters; others share a class
_TRIPLES = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_stops = re.compile(r"[.!?…。\n]+(?=\s|$)")
_apart = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_maybe_apart = re.compile(r" \S \S[ \n]").search
#: Digits and signs that stand for letters.
_LOOKALIKE = str.maketrans("013457@$!|", "oieastasii")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_noise = re.compile(r"[\W_]+")
_END = LETTERS  # a class that no letter has: between words
#: Marks of a word's start and end, letters like others to the kernel.
FIRST, LAST = "\x02", "\x03"


def plain(word: str) -> str:
    """The letters that the kernel sees of a word: lower case, look-alikes resolved, other signs dropped."""
    low = word.lower()
    if not low.isalpha():
        core = low.strip(".,;:!?\"'()[]*#$%&…")
        low = _noise.sub("", core if core.isalpha() else core.translate(_LOOKALIKE))
    return f"{FIRST}{low}{LAST}" if low else ""


def sentences(text: str | None) -> list[list[str]]:
    """The windows of a text as lists of raw words."""
    if not text:
        return []
    if _maybe_apart(f" {text} "):
        text = _apart.sub(lambda m: m[0].replace(" ", "").replace("\t", ""), text)
    out = []
    for s in _stops.split(text):
        w = s.split()
        out += [w] if len(w) <= WINDOW_WORDS else [w[i : i + WINDOW_WORDS] for i in range(0, len(w), WINDOW_WORDS)]
    return out


def triples(some: list[str], column: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kernel's feature map of plain words: (word, triple, weight), a row for each occurrence.

    Weights are divided by the norm that a word of that length has if its triples differ, the least that it
    can have. With ``column``, only triples that have one are returned, by it.
    """
    lengths = np.fromiter(map(len, some), np.int64, len(some))
    gap = SPAN - 1
    c = np.frombuffer(("\n" * gap).join([*some, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.where(c == 10, _END, np.where((c >= 97) & (c <= 122), c - 97, np.where(c <= 3, c + 24, 28 + c % (LETTERS - 28)))).astype(np.int32)
    owner = np.repeat(np.arange(len(some), dtype=np.int32), lengths + gap)
    norm = np.sqrt(sum(np.maximum(lengths - j, 0) * DECAY ** (2 * (j + 1)) for _, j in _TRIPLES))
    scale = (1 / np.maximum(norm, DECAY**3)).astype(np.float32)
    found = []
    n = len(classes)
    solid = classes != _END
    for i, j in _TRIPLES:
        if n <= j:
            continue
        # no word is nearer to the next than the span: two letters within it are of one word
        ok = solid[: n - j] & solid[i : n - j + i] & solid[j:]
        code = (classes[: n - j] * LETTERS + classes[i : n - j + i]) * LETTERS + classes[j:]
        if column is not None:
            code = column[np.where(ok, code, 0)]
            ok &= code >= 0
        at = np.flatnonzero(ok)
        found.append((owner[at], code[at], scale[owner[at]] * np.float32(DECAY ** (j + 1))))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return tuple(map(np.concatenate, zip(*found)))


def norms(some: list[str]) -> np.ndarray:
    """The norm of each word's feature map as ``triples`` gives it: over 1 where triples repeat."""
    word, triple, weight = triples(some)
    key = word.astype(np.int64) * LETTERS**3 + triple
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight, first) if len(first) else weight
    return np.sqrt(np.maximum(np.bincount(key[first] // LETTERS**3, weights=total * total, minlength=len(some)), 1e-6))


@dataclass
class Model:
    landmarks: list[str]
    column: np.ndarray  # of each triple its row in ``table``, -1: no landmark has it
    table: np.ndarray  # [triples, landmarks]
    weights: np.ndarray  # of k(x), the Nyström map and the SVM in one
    bias: float
    slope: tuple[float, float]
    offset: float

    @staticmethod
    def of(landmarks: list[str]) -> Model:
        word, triple, weight = triples(landmarks)
        used = np.unique(triple)
        column = np.full(LETTERS**3, -1, np.int32)
        column[used] = np.arange(len(used))
        dense = np.zeros((len(used), len(landmarks)), np.float32)
        np.add.at(dense, (column[triple], word), weight)
        dense /= norms(landmarks).astype(np.float32)
        return Model(landmarks, column, dense, np.zeros(len(landmarks)), 0.0, (1.0, 0.0), 0.0)

    def kernels(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words that come near a landmark, and their kernel values [words, landmarks]."""
        at, values = [], []
        # a triple is in few landmarks: entries (landmark, weight) of each row of the table, one row after the other
        held, landmark = np.nonzero(self.table)
        entry, count = self.table[held, landmark], np.bincount(held, minlength=len(self.table))
        begin, n = np.cumsum(count) - count, len(self.landmarks)
        for k in range(0, len(some), 4096):
            word, row, weight = triples(some[k : k + 4096], self.column)
            if not len(word):
                continue
            times = count[row]
            ends = np.cumsum(times)
            place = np.arange(ends[-1]) - np.repeat(ends - times - begin[row], times)
            cell = np.repeat(word.astype(np.int64) * n, times) + landmark[place]
            size = int(word.max()) + 1
            value = np.bincount(cell, weights=np.repeat(weight, times) * entry[place], minlength=size * n).reshape(size, n)
            near = np.flatnonzero((value >= FAINT).any(axis=1))  # norms are 1 at least
            if not len(near):
                continue
            value = value[near] / norms([some[k + i] for i in near.tolist()])[:, None]
            value = np.where(value >= FAINT, value**POWER, 0).astype(np.float32)
            still = value.any(axis=1)
            at.append(k + near[still])
            values.append(value[still])
        if not at:
            return np.zeros(0, np.int64), np.zeros((0, n), np.float32)
        return np.concatenate(at), np.concatenate(values)

    def windows(self, some: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """The words as they are compared, whole or in letter windows, in blocks: owners and letters."""
        sizes = [(n + max(1, n // 4), max(1, n // 4)) for n in sorted({max(5, len(w)) for w in self.landmarks})]
        owner, parts = [], []
        for i, w in enumerate(some):
            if len(w) <= WHOLE:
                owner.append(i)
                parts.append(w)
            else:
                for size, step in sizes:
                    for at in range(0, max(1, len(w) - size + step), step):
                        owner.append(i)
                        parts.append(w[at : at + size])
                        if len(parts) >= 1 << 16:
                            yield np.array(owner), parts
                            owner, parts = [], []
            if len(parts) >= 1 << 16:
                yield np.array(owner), parts
                owner, parts = [], []
        if parts:
            yield np.array(owner), parts

    def contributions(self, some: list[str]) -> np.ndarray:
        """Each word's part in the decision value of a sentence that holds it; of windows the highest."""
        out = np.full(len(some), -np.inf)
        for owner, parts in self.windows(some):
            part = np.zeros(len(parts))
            at, values = self.kernels(parts)
            part[at] = values @ self.weights
            np.maximum.at(out, owner, part)
        return out

    def nearest(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``kernels``, for words of any length: of windows the one that comes nearest to a landmark."""
        best: dict[int, np.ndarray] = {}
        for owner, parts in self.windows(some):
            at, values = self.kernels(parts)
            for i, v in zip(owner[at].tolist(), values):
                if i not in best or v.max() > best[i].max():
                    best[i] = v
        order = sorted(best)
        return np.array(order, np.int64), np.array([best[i] for i in order]).reshape(len(order), len(self.landmarks))

    def margin(self, windows: list[list[str]], memo: dict[str, float]) -> tuple[float, float]:
        """The highest decision value of a sentence, and of a passage (sentences in a row, PASSAGE words or a few more); the bias alone without sentences."""
        get = memo.__getitem__
        sentence = passage = None
        held: set[str] = set()
        size = 0
        for w in windows:
            kinds = set(w)
            value = sum(map(get, kinds))
            sentence = value if sentence is None else max(sentence, value)
            held |= kinds
            size += len(w)
            if size >= PASSAGE:
                value = sum(map(get, held))
                passage = value if passage is None else max(passage, value)
                held, size = set(), 0
        if held:
            value = sum(map(get, held))
            passage = value if passage is None else max(passage, value)
        return (sentence or 0.0) + self.bias, (passage or 0.0) + self.bias

    def score(self, margin: tuple[float, float]) -> float:
        z = self.slope[0] * margin[0] + self.slope[1] * margin[1] + self.offset
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -60, 60))))


def choose_landmarks(docs: list[set[str]], toxic: np.ndarray) -> list[str]:
    """Words that hold the letter groups that tell toxic documents best; never none.

    Groups of several lengths, marks of start and end included, are candidates, not words: an insult's endings may all differ. They are taken
    greedily by what they add: the log ratio of their smoothed shares among toxic and clean documents, times the
    toxic documents that hold them and are not yet covered COVER times. A group's most frequent words become landmarks.
    """
    spread = Counter(w for d, t in zip(docs, toxic) if t for w in d if len(w) >= 5)
    short, long = GROUP

    def groups(words: set[str]) -> set[str]:
        return {w[i : i + n] for w in words if 5 <= len(w) <= WHOLE for n in range(short, long + 1) for i in range(len(w) - n + 1)}

    counts = Counter(g for d, t in zip(docs, toxic) if t for g in groups(d))
    least = min(2, int(toxic.sum()), max(counts.values(), default=0))
    counts = {g: k for g, k in counts.items() if k >= least}
    cleanly = Counter(g for d, t in zip(docs, toxic) if not t for g in groups(d) & counts.keys())
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    plainly = Counter(w for d, t in zip(docs, toxic) if not t for w in d if w in spread)

    def telling(k1: int, k0: int) -> float:
        """Log ratio of the smoothed shares, less its standard error."""
        return float(np.log((k1 + 0.5) / (n1 + 1)) - np.log((k0 + 0.5) / (n0 + 1)) - np.sqrt(1 / k1 + 1 / (k0 + 0.5)))

    told = {w: telling(k, plainly[w]) if k >= least else 0.0 for w, k in spread.items()}
    ratio = {g: telling(k, cleanly[g]) for g, k in counts.items()}
    ratio = {g: r for g, r in ratio.items() if r > LEAST}
    held: dict[str, list[int]] = {g: [] for g in ratio}
    for i, (d, t) in enumerate(zip(docs, toxic)):
        if t:
            for g in groups(d) & ratio.keys():
                held[g].append(i)
    times = np.zeros(len(docs))
    add = lambda g: ratio[g] * sum(max(0.0, 1 - times[i] / COVER) for i in held[g])
    queue = [(-ratio[g] * len(held[g]), g) for g in held]
    heapq.heapify(queue)
    out: list[str] = []
    while queue and len(out) < LANDMARKS:
        old, g = heapq.heappop(queue)
        now = -add(g)
        if now > -least * LEAST:
            continue
        if now > old + 1e-9:
            heapq.heappush(queue, (now, g))
            continue
        words = [w for w in spread if g in w and len(w) <= WHOLE and w not in out and told[w] > LEAST]
        out += sorted(words, key=lambda w: (-spread[w] * told[w], len(w), w))[:PER_GROUP]
        for i in held[g]:
            times[i] += 1
    return (out or sorted(spread, key=lambda w: (-spread[w], w)) or [f"{FIRST}aaa{LAST}"])[:LANDMARKS]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, rounds: int = 200, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, by Adam."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    live = weight > 0
    x = x if live.all() else x[live]
    y, weight = y[live].astype(np.float32), (weight[live] / weight.sum()).astype(np.float32)
    for t in range(1, rounds + 1):
        slack = np.maximum(0.0, 1 - y * (x @ w.astype(np.float32) + np.float32(b))) * weight * y
        g = np.append(-2 * (slack @ x) + 2 * l2 * w, -2 * slack.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def altered(word: str, rng: random.Random) -> str:
    """The word as someone would write it to get past a word list."""
    letters, kind = list(word[1:-1]), rng.randrange(7)
    if kind in (0, 1, 2):  # one or two letters in between
        for _ in range(1 + kind // 2):
            letters.insert(rng.randrange(1, len(letters)), rng.choice(_ALPHABET))
    elif kind == 3:  # one left out
        del letters[rng.randrange(1, len(letters) - 1)]
    elif kind == 4:  # two swapped
        i = rng.randrange(len(letters) - 1)
        letters[i], letters[i + 1] = letters[i + 1], letters[i]
    elif kind == 5:  # one doubled
        i = rng.randrange(len(letters))
        letters.insert(i, letters[i])
    else:  # glued to others
        letters = [rng.choice(_ALPHABET) for _ in range(3)] + letters
    return "".join((FIRST, *letters, LAST))


def train(texts: list[str], toxic: np.ndarray, rounds: int = 3, prior: float | None = None) -> Model | None:
    """Fit landmarks, SVM and curve on labelled documents; None if there is nothing to tell apart.

    ``prior`` is the share of toxic documents where the texts were drawn from, by default theirs.
    """
    if not toxic.any() or toxic.all():
        return None
    docs = [sentences(t) for t in texts]
    letters = {w: plain(w) for w in {w for d in docs for s in d for w in s}}
    kinds = [{letters[w] for s in d for w in s} for d in docs]
    # near copies of a document count once: they share the words with the smallest hashes
    marks = [tuple(sorted(zlib.crc32(w.encode()) for w in k)[:4]) for k in kinds]
    once = sorted(dict(zip(reversed(marks), reversed(range(len(marks))))).values())
    landmarks = choose_landmarks([kinds[i] for i in once], toxic[once])
    model = _fit(docs, toxic, letters, landmarks, rounds, prior)
    # words of clean documents that look like insults become landmarks too, and the model is fitted again
    clean = Counter(w for i in once if not toxic[i] for w in kinds[i] if len(w) >= 5)
    often = [w for w, k in clean.items() if k > 1]
    false = {w: c * clean[w] for w, c in zip(often, model.contributions(often).tolist()) if c > ALARM and len(w) <= WHOLE} if often else {}
    mined = sorted(false.keys() - set(landmarks), key=lambda w: (-false[w], w))[:ALARMS]
    return _fit(docs, toxic, letters, landmarks + mined, rounds, prior) if mined else model


def _fit(docs: list[list[list[str]]], toxic: np.ndarray, letters: dict[str, str], landmarks: list[str], rounds: int, prior: float | None) -> Model:
    """SVM and curve over given landmarks."""
    model = Model.of(landmarks)
    at, values = model.kernels(landmarks)
    gram = np.zeros((len(landmarks), len(landmarks)))
    gram[at] = values
    spectrum, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = spectrum > 1e-4 * spectrum.max()
    nystroem = (vectors[:, keep] / np.sqrt(spectrum[keep])).astype(np.float32)  # K^(-1/2) up to a rotation
    raw = sorted(letters)
    at, values = model.nearest([letters[w] for w in raw])
    features = values @ nystroem
    row = {raw[i]: k for k, i in enumerate(at.tolist())}
    # sentences without a word near any landmark all have the features zero: one weighted row a document
    owner, held = [], []
    zeros = np.zeros(len(docs))
    for i, d in enumerate(docs):
        for s in d:
            hit = [row[w] for w in sorted(set(s)) if w in row]
            if hit:
                owner.append(i)
                held.append(hit)
            else:
                zeros[i] += 1
    found = len(owner)
    owner = np.array([*owner, *range(len(docs))])
    x = np.zeros((found + len(docs), features.shape[1]), np.float32)
    for k, hit in enumerate(held):
        x[k] = features[hit].sum(axis=0)
    weight = np.concatenate((np.ones(found), zeros))
    y = np.where(toxic[owner], 1.0, -1.0)
    w, b = _fitted_rounds(x, y, weight, owner, len(docs), rounds)

    # of each toxic document the worst sentence again, its worst word altered
    margin = x[:found] @ w + b
    worst: dict[int, int] = {}
    for k in range(found):
        i = int(owner[k])
        if toxic[i] and margin[k] > 0 and (i not in worst or margin[k] > margin[worst[i]]):
            worst[i] = k
    rng, more, base, words = random.Random(8), [], [], []
    parts = features @ w
    for i, k in worst.items():
        top = max(held[k], key=lambda r: parts[r])
        word = letters[raw[at[top]]]
        if 6 <= len(word) <= WHOLE and parts[top] >= (margin[k] - b) / 2:
            for _ in range(ALTERED):
                more.append(i)
                base.append(x[k] - features[top])
                words.append(altered(word, rng))
    if words:
        near, values = model.nearest(words)
        base = np.array(base)
        base[near] += values @ nystroem
        n = len(x)
        x, y = np.concatenate((x, base)), np.concatenate((y, np.ones(len(base))))
        weight, owner = np.concatenate((weight, np.full(len(base), 1.0 / ALTERED))), np.concatenate((owner, more))
        w, b = _fitted_rounds(x, y, weight, owner, len(docs), rounds, np.arange(len(x)) >= n)
    model.weights, model.bias = nystroem @ w, float(b)
    memo = dict(zip(raw, model.contributions([letters[w] for w in raw]).tolist()))
    z = np.array([model.margin(d, memo) for d in docs]).reshape(len(docs), 2)
    share = prior if prior is not None else toxic.mean()
    each = np.where(toxic, share / toxic.sum(), (1 - share) / (~toxic).sum()) * len(docs)
    if words:  # an altered copy counts little: few are written so
        alone = base @ w + b
        # the rest of its passage stays as it is
        z = np.concatenate((z, np.stack((alone, alone + z[more, 1] - z[more, 0]), axis=1)))
        toxic = np.concatenate((toxic, np.ones(len(base), bool)))
        each = np.concatenate((each, np.full(len(base), each.min() / ALTERED)))
    model.slope, model.offset = curve(z, toxic, each)
    return model


def _fitted_rounds(x: np.ndarray, y: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, rounds: int, fixed: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The SVM, repeated with each toxic document's highest sentences (and the rows that are ``fixed``) only."""
    first, w, b = weight, np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        balanced = weight * np.where(y > 0, 0.5 / max(1e-9, weight[y > 0].sum()), 0.5 / max(1e-9, weight[y < 0].sum()))
        w, b = squared_hinge(x, y, balanced)
        margin = x @ w + b
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, margin)
        # of each toxic document its highest sentences stay positive, the rest counts no longer
        high = margin >= np.where(top > 0, top / 2, top)[owner]
        weight = np.where(y < 0, first, high.astype(float))
        if fixed is not None:
            weight = np.where(fixed, first, weight)
    return w, b


def curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, float], float]:
    """Slopes and offset of the logistic curve through pairs of decision values (Newton steps, mildly penalised); a slope below 0 is 0."""

    def newton(x: np.ndarray) -> np.ndarray:
        x = np.column_stack((x, np.ones(len(x))))
        a = np.append(np.full(x.shape[1] - 1, 0.5), 0.0)
        pull = np.append(np.full(x.shape[1] - 1, 0.1), 0.0)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
            h = weight * p * (1 - p) + 1e-9
            step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(pull), x.T @ (weight * (p - y)) + pull * a)
            a = a - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        return a

    first, second, offset = newton(z).tolist()
    if first < 0 or second < 0:
        k = 0 if second < 0 else 1
        slope, offset = newton(z[:, k : k + 1]).tolist()
        first, second = (max(0.0, slope), 0.0) if k == 0 else (0.0, max(0.0, slope))
    return (first, second), float(offset)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, fitted on a bounded sample of labelled documents that are not held out."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("_t")).where("doc_id is not null and _t in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("_t").alias("_t"))
    marked = marked.withColumn("_h", F.xxhash64(F.lit(8), "doc_id"))
    shares = {r["_t"]: r["n"] for r in marked.groupBy("_t").agg(F.count("*").alias("n")).collect()}  # two rows
    # the sample is drawn from the labels of texts that may join it, so only its texts, not all labelled ones, are moved
    short = docs.where(F.length("text").between(1, TRAIN_CHARS)).select("doc_id")
    drawn = marked.join(short, "doc_id", "left_semi")
    sample = None
    for value, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        part = drawn.where(F.col("_t") == value).orderBy("_h", "doc_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, TRAIN_CHARS)).join(F.broadcast(sample), "doc_id")  # at most TRAIN_TOXIC + TRAIN_CLEAN rows
    texts, toxic = [], []
    for r in rows.orderBy("_h", "doc_id", "text").limit(TRAIN_TOXIC + TRAIN_CLEAN).select("text", "_t").collect():
        texts.append(r.text)
        toxic.append(bool(r["_t"]))
    return train(texts, np.array(toxic, bool), prior=shares.get(1, 0) / max(1, sum(shares.values())))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousands of numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m is not None:
            memo = keep("toxicity", m.weights.tobytes(), dict)
        for b in batches:
            n = b.num_rows
            if m is None:
                scores = [0.0] * n
            else:
                docs = [sentences(t) for t in b.column(2).to_pylist()]
                if len(memo) > MEMO:
                    memo.clear()
                new = list({w for d in docs for s in d for w in s if w not in memo})
                if new:
                    memo.update(zip(new, m.contributions([plain(w) for w in new]).tolist()))
                scores = [m.score(m.margin(d, memo)) for d in docs]
                for w in new:
                    if len(w) > LONGEST_KEPT:
                        del memo[w]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, fitted(docs, table(spark, sf_dir, "labels")))
