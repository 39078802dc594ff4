"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

A slice of the corpus (consecutive documents of a partition, some SLICE characters) is cut into words by the tokenizer's pattern.
Its distinct words, each once however often and in however many documents it occurs, stand as bytes in one array, and an
inverted index leads from a token pair, named by the rank of the token that it merges into, to the places where it
stands. Merges are taken from a heap in rank order over all words together; one merge touches the places of its pair and their
neighbours only, whose new pairs enter the index. Frequent pairs are merged by array operations, the long tail
of rare ones place by place. Where a merge makes a pair of lower rank, the rest of its own places wait until that
pair is merged, so every word sees the lowest rank first, leftmost place first, as the library does. A word that is a
token as a whole is that token. The words' ids are then spread over their occurrences.

The slices are independent, so encoding moves no data between tasks, and a lost task is repeated alone. A text is read
whole; memory holds one slice, or one text if that is longer.

Defined cases: a null text is empty and has no ids, null ids decode to nothing. Strings of special tokens are ordinary text.
Equal rows stay equal rows. Columns of the input whose names are those of added columns are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, small_batches, table, tokenizer_file

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a slice (its last document may exceed it), and the average places of a pair below which they are taken one by one.
SLICE, FEW = 4 << 20, 8
NONE = (1 << 31) - 1
ADDED = ("ids", "n_tokens", "ids_sha256")

# The public pattern that ``classed`` reads by letter classes; other patterns go through the regex library.
PUBLIC = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, OTHER, SPACE = range(4)


def letter_classes() -> np.ndarray:
    """Class of every code point."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, runs in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(runs, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def classed(texts: list[str], classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts by PUBLIC, one after the other, and how many each text has.

    A word is a run of one class. The last character of white space before other characters is left out of
    its run: a plain space joins what follows, any other stands alone. An apostrophe that joins no space and stands alone before
    letters takes s, t, m, d, re, ve or ll from them.
    """
    joined = "".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n, ends = len(chars), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    if not n:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    kind = classes[chars]
    begins = np.zeros(n + 1, bool)  # of texts; the end is one too
    begins[0] = True
    begins[ends] = True
    start = begins.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    at, end = runs[:-1], runs[1:]
    follows = ~begins[end]  # another run of the same text
    word = start[:n].copy()
    gap = follows & (kind[at] == SPACE)
    word[end[gap] - 1] = True
    word[end[gap & (chars[end - 1] == 32)]] = False
    quote = np.flatnonzero(follows & (chars[at] == 39) & (end - at == 1) & word[at])
    quote = quote[kind[end[quote]] == LETTER]
    if len(quote):
        first = end[quote]
        length = end[quote + 1] - first
        one, two = chars[first], chars[np.minimum(first + 1, n - 1)]
        took = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        pair = ((np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))) & (length >= 2)
        took = np.where(pair, 2, took)
        first, length, took = first[took > 0], length[took > 0], took[took > 0]
        word[first] = False
        more = length > took
        word[(first + took)[more]] = True
    places = np.flatnonzero(word)
    octets = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
    offset = np.concatenate(([0], np.cumsum(octets, dtype=np.int64)))
    offsets = np.concatenate((offset[places], offset[n:]))
    words = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(joined.encode()))
    return words, np.diff(np.searchsorted(places, ends), prepend=0)


def matched(texts: list[str], pattern) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts by any pattern."""
    found = [pattern.findall(t) for t in texts]
    return pa.array([w for f in found for w in f], pa.large_string()), np.fromiter(map(len, found), np.int64, len(found))


class Merges:
    """The ranks of a tokenizer file, and the replay of its merges."""

    def __init__(self, where: str):
        self.rank: dict[bytes, int] = {}
        with open(where, "rb") as f:
            for line in f:
                if line.strip():
                    word, n = line.split()
                    self.rank[base64.b64decode(word)] = int(n)
        self.bytes_of = {n: w for w, n in self.rank.items()}
        self.byte_id = np.array([self.rank[bytes((b,))] for b in range(256)], np.int32)
        #: every pair of tokens that makes a token: left << 32 | right -> the token's rank
        self.made = {self.rank[w[:i]] << 32 | self.rank[w[i:]]: r for w, r in self.rank.items() for i in range(1, len(w)) if w[:i] in self.rank and w[i:] in self.rank}
        keys, values = np.fromiter(self.made, np.int64, len(self.made)), np.fromiter(self.made.values(), np.int32, len(self.made))
        #: the same as sorted arrays, by the left token and by the right one
        self.by_left, self.by_right = (self._sorted(k, values) for k in (keys, (keys & 0xFFFFFFFF) << 32 | keys >> 32))

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return np.append(keys[order], np.iinfo(np.int64).max), np.append(values[order], NONE).astype(np.int32)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens."""
        keys, values = self.by_left
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(keys, key)
        return np.where(keys[at] == key, values[at], NONE).astype(np.int32)

    @staticmethod
    def ranks_with(side: tuple[np.ndarray, np.ndarray], one: int, others: np.ndarray) -> np.ndarray:
        """Rank of the pairs that one token makes with each of the others, in the few pairs that it is in on that side."""
        keys, values = side
        low, high = np.searchsorted(keys, (one << 32, one + 1 << 32)).tolist()
        if low == high:
            return np.full(len(others), NONE, np.int32)
        key = others.astype(np.int64) + (one << 32)
        at = low + np.minimum(np.searchsorted(keys[low:high], key), high - low - 1)
        return np.where(keys[at] == key, values[at], NONE)

    def replay(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie, as bytes, one after the other, and how many each has."""
        n, ends = len(flat), np.cumsum(sizes)
        last = np.zeros(n, bool)
        last[ends - 1] = True
        at = np.arange(n, dtype=np.int32)
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        marked = np.zeros(len(sizes), bool)  # words, for as long as one merge looks at them
        token = self.byte_id[flat]
        after = np.where(last, -1, at + 1).astype(np.int32)
        before = np.where(np.roll(last, 1), -1, at - 1).astype(np.int32)
        pair = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(~last)
        pair[inner] = self.ranks_of(token[inner], token[inner + 1])
        found = np.flatnonzero(pair < NONE)
        found = found[np.argsort(pair[found], kind="stable")]
        index: dict[int, list[int]] = {}  # the inverted index
        if len(found):
            starts = np.flatnonzero(np.diff(pair[found], prepend=-1))
            for r, places in zip(pair[found][starts].tolist(), np.split(found, starts[1:])):
                index[r] = places.tolist()
        heap = sorted(index)
        average = float(2 * FEW)
        while heap and average >= FEW:
            r = heapq.heappop(heap)
            places = index.pop(r)
            average += 0.02 * (len(places) - average)
            if len(places) >= FEW:
                places = self._together(r, places, word, marked, token, after, before, pair, index, heap)
            self._one_by_one(r, places, token, after, before, pair, index, heap)
        if heap:
            lists = [x.tolist() for x in (token, after, before, pair)]
            while heap:
                r = heapq.heappop(heap)
                self._one_by_one(r, index.pop(r), *lists, index, heap)
            token = np.array(lists[0], np.int32)
        alive = token >= 0
        return token[alive], np.diff(np.cumsum(alive)[ends - 1], prepend=0)

    def _together(self, r: int, places: list[int], word, marked, token, after, before, pair, index: dict[int, list[int]], heap: list[int]) -> list[int]:
        """One merge at all places of its pair at once; the places of words where they touch, or make a pair of lower rank, are given back."""
        p = np.sort(np.array(places, np.int32))
        p = p[pair[p] == r]
        q = after[p]
        nxt, left = after[q], before[p]
        new_right = np.where(nxt >= 0, self.ranks_with(self.by_left, r, token[nxt]), NONE)
        new_left = np.where(left >= 0, self.ranks_with(self.by_right, r, token[left]), NONE)
        apart = (new_right < r) | (new_left < r)
        apart[:-1] |= (q[:-1] == p[1:]) | (nxt[:-1] == p[1:])
        rest: list[int] = []
        if apart.any():
            there = word[p[apart]]
            marked[there] = True
            apart = marked[word[p]]
            marked[there] = False
            rest, here = p[apart].tolist(), ~apart
            p, q, nxt, left, new_right, new_left = (x[here] for x in (p, q, nxt, left, new_right, new_left))
        has_next, has_left = nxt >= 0, left >= 0
        token[p], token[q], pair[q], after[p] = r, -1, NONE, nxt
        before[nxt[has_next]] = p[has_next]
        pair[p], pair[left[has_left]] = new_right, new_left[has_left]
        for new, where in ((new_right, p), (new_left, left)):
            real = new < NONE
            for k, x in zip(new[real].tolist(), where[real].tolist()):
                if k in index:
                    index[k].append(x)
                else:
                    index[k] = [x]
                    heapq.heappush(heap, k)
        return rest

    def _one_by_one(self, r: int, places: list[int], token, after, before, pair, index: dict[int, list[int]], heap: list[int]) -> None:
        """The same merge place by place, from the left, until one makes a pair of lower rank."""
        get = self.made.get
        places.sort()
        for k, p in enumerate(places):
            if pair[p] != r:
                continue  # merged away by a neighbour
            q = after[p]
            nxt = after[p] = after[q]
            token[p], token[q], pair[q], pair[p] = r, -1, NONE, NONE
            lower = False
            if nxt >= 0:
                before[nxt] = p
                new = get(r << 32 | int(token[nxt]), NONE)
                pair[p] = new
                if new < NONE:
                    if new in index:
                        index[new].append(p)
                    else:
                        index[new] = [p]
                        heapq.heappush(heap, new)
                    lower = new < r
            left = before[p]
            if left >= 0:
                new = get(int(token[left]) << 32 | r, NONE)
                pair[left] = new
                if new < NONE:
                    if new in index:
                        index[new].append(left)
                    else:
                        index[new] = [left]
                        heapq.heappush(heap, new)
                    lower = lower or new < r
            if lower and k + 1 < len(places):
                if r in index:
                    index[r] += places[k + 1 :]
                else:
                    index[r] = places[k + 1 :]
                    heapq.heappush(heap, r)
                return

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and how many each has: whole tokens, and the rest by one replay."""
        coded = words.cast(pa.large_binary())
        whole = [self.rank.get(w, -1) for w in coded.to_pylist()]
        first = np.array(whole, np.int32)
        todo = first < 0
        sizes = np.ones(len(first), np.int64)
        if todo.any():
            rest = coded.filter(pa.array(todo))
            offsets = np.frombuffer(rest.buffers()[1], np.int64)[rest.offset : rest.offset + len(rest) + 1]
            flat = np.frombuffer(rest.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            replayed, n = self.replay(flat, np.diff(offsets))
            sizes[todo] = n
        ids = np.empty(int(sizes.sum()), np.int32)
        slot = np.repeat(todo, sizes)
        ids[~slot] = first[~todo]
        if todo.any():
            ids[slot] = replayed
        return ids, sizes

    def encode(self, texts: list[str | None], words_of: Callable) -> list[np.ndarray]:
        """Ids of each text of a slice."""
        words, counts = words_of([t or "" for t in texts])
        coded = words.dictionary_encode()
        ids, sizes = self.of_words(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        begins, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = ids[np.arange(ends[-1]) - np.repeat(ends[:-1] - begins, n)]
        return np.split(flat, ends[np.cumsum(counts)][:-1]) if len(texts) else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def merges(where: str) -> Merges:
    return keep("bpe", where, lambda: Merges(where))


def public_pattern() -> str:
    """The pattern that cuts texts into words, as the public tokenizer files have it."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _kinds(df: DataFrame, columns: tuple[str, ...]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def word_cutter(pattern: str) -> Callable:
    if pattern == PUBLIC:
        classes = keep("bpe", "classes", letter_classes)
        return lambda texts: classed(texts, classes)
    compiled = regex.compile(pattern)
    return lambda texts: matched(texts, compiled)


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, and each text's ``ids`` (array), ``n_tokens`` and ``ids_sha256`` (of little-endian unsigned 32-bit integers)."""
    where, pattern = tokenizer_file(ranks), pattern or public_pattern()

    def coded(held: list[pa.RecordBatch], m: Merges, words_of: Callable) -> Iterator[pa.RecordBatch]:
        every = iter(m.encode([t for b in held for t in b.column(len(carry)).to_pylist()], words_of))
        for b in held:
            ids = [next(every) for _ in range(b.num_rows)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))
            digests = pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], lists, pa.array(sizes), digests], names=[*carry, *ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words_of = merges(where), word_cutter(pattern)
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.column(len(carry)).nbytes for x in held) >= SLICE:
                yield from coded(held, m, words_of)
                held = []
        if held:
            yield from coded(held, m, words_of)

    return docs.select(*carry, F.col("text").cast("string").alias("_gleaner_text")).mapInArrow(run, f"{_kinds(docs, carry)}ids array<int>, n_tokens long, ids_sha256 string")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """All columns of ``encoded`` but ``ids``, and the bytes (``decoded``) that they stand for."""
    where = tokenizer_file(ranks)
    others = tuple(c for c in encoded.columns if c not in ("ids", "decoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(where)
        for b in batches:
            texts = [m.decode(x or ()) for x in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.binary())], names=[*others, "decoded"])

    return encoded.select(*others, "ids").mapInArrow(run, f"{_kinds(encoded, others)}decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    both = decode(encode(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    return both.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
