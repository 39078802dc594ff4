"""Token-ID shards with a minimal-perfect-hash index.

Store layout (all numbers little-endian), in a folder that every executor reaches:

``NNNNN.ids``
    the documents' ids one after another, raw, each ``width`` bytes (2 where the vocabulary allows,
    else 4), in ascending document order; each document ends with the end id;
``NNNNN.idx``
    an 8-byte magic, seven int64 (version, width, rows, keys, rows with a null key, bits, levels),
    the levels' sizes in bits, the offsets of the rows in ids (rows + 1 int64), for each hash slot
    a 32-bit fingerprint, the first row of its key and its number of rows, a rank sample for each
    64 bits, and the bits;
``manifest``
    a Parquet table with a row for each shard: its number, smallest and largest key, rows, ids, rows with a null
    key, and ``base``, the ids of all shards before it. Lookups read the rows that their keys' range meets.

The index is a minimal perfect hash in levels (Limasset et al., "Fast and scalable minimal
perfect hashing for massive key sets", 2017): a key that alone hashes to a bit of a level sets it, the
others go on to the next level; the key's slot is the number of bits set before its own. A key
is found by its range (shard), at most a few bits and one rank; the stored fingerprint tells
keys that are not there apart, but for one in 2**32.

Rows are dealt over shards by ranges of (key, text, input partition), so that even equal rows spread, and a
shard is written by the task that tokenised it, streaming; nothing reaches the driver. Files appear under their name by a rename
after they are complete, and a repeated task writes the same bytes.

Encoding calls the tokenizers library. Byte-level BPE splits a text before any space or line feed that
a character other than white space follows, so each distinct word of a group of texts is encoded once and remembered, and
Arrow puts the texts' ids together; a text with other white space goes to the library whole.

Defined cases: null and empty texts are just the end id; repeated doc_ids are stored row by row
(lookups return all of them) and rows with a null doc_id after all others; a rerun writes
a new folder; extra columns are ignored; an empty table has a manifest without rows.
"""

from __future__ import annotations

import codecs
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, crc_of_ids, fresh_dir, keep, saved, small_batches, table, tokenizer_file

MODEL = "byte_bpe_50k.json"
END_ID = 0
#: Rows of a shard, about.
SHARD_ROWS = 8_000
#: Words that a Python worker remembers at most, and the longest that it keeps after their group.
MEMO, LONGEST_KEPT = 3 << 18, 64
#: Bytes of text whose words are looked up together, about: less than twice this and one text.
GROUP = 4 << 20
#: Shards whose ids before them are summed in one task.
BLOCK = 1 << 12
#: Bytes of a payload read at once where many of its rows are wanted.
READ_AHEAD = 4 << 20
MAGIC, VERSION = b"GLNTOKS1", 1
GAMMA, MAX_LEVELS = 1.7, 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: After a line feed or not, letters and the stops after them: one or two words for the library's splitter.
_plain = re.compile("\n?[A-Za-zÀ-ÖØ-öø-ſ]+[.,;:!?#*$%&]*").fullmatch
_stops = re.compile("[.,;:!?#*$%&]+")
#: Characters that no definition of white space holds.
_solid = re.compile("[!-~¡-ᙿ‐-‧‰-⁞⁰-⿿、-﷿！-￯\U00010000-\U0010ffff]").match
_UNSAFE = b"?"  # no whole number of ids


# --- encoding


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE vocabularies (keyed for str.translate)."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """The library's byte-level BPE, with a bounded memo of words."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.lib = Tokenizer.from_file(file)
        self.width = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        alphabet = byte_alphabet()
        space, feed = alphabet[32], alphabet[10]
        # the library's model for words that need no splitter: written in its alphabet, a space between them
        self.words = Tokenizer(self.lib.model)
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        self.letters = " " + "".join(alphabet[b] for b in range(1, 256))  # byte 0 parts words
        pieces = self.lib.get_vocab()
        self.leads = np.zeros(max(pieces.values(), default=0) + 1, bool)  # ids that begin with a space or line feed
        self.leads[[i for t, i in pieces.items() if t[:1] in (space, feed)]] = True
        # no piece joins a line feed to a letter's first byte, so it may stand before a word
        begins = {alphabet[b] for b in (*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0xC3, 0xC4, 0xC5)}
        alone = feed in pieces and not any(t[1] in begins for t in pieces if t[:1] == feed and len(t) > 1)
        self.by_word = type(self.lib.pre_tokenizer).__name__ == "ByteLevel" and sys.byteorder == "little" and alone
        self.feed = self.pack(self.lib.encode("\n", add_special_tokens=False).ids)
        self.memo: dict[str, bytes] = {}  # words after a space, and after a line feed with it

    def pack(self, ids: list[int]) -> bytes:
        return array(self.width.char, ids).tobytes()

    def direct(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of letters and stops, straight from the library's model."""
        if not words:
            return []
        raw = _stops.sub("\0\\g<0>", " " + "\0 ".join(words)).replace(" \n", "\n").encode()
        ids = np.array(self.words.encode_batch_fast([codecs.charmap_decode(raw, "strict", self.letters)[0]], add_special_tokens=False)[0].ids, self.width)
        cuts = [*(np.flatnonzero(self.leads[ids]) * self.width.itemsize).tolist(), ids.nbytes]
        if len(cuts) != len(words) + 1:
            raise RuntimeError("words and ids do not meet")
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct words that are not in the memo; the short ones are remembered."""
        plain = list(filter(_plain, words))
        got = dict(zip(plain, self.direct(plain)))
        if len(got) < len(words):
            others = [w for w in words if w not in got]
            got.update(dict.fromkeys(others, _UNSAFE))
            slow = [w for w in others if _solid(w, w[:1] == "\n")]
            fed = [w[0] == "\n" for w in slow]
            for w, f, e in zip(slow, fed, self.lib.encode_batch([w[1:] if f else " " + w for w, f in zip(slow, fed)], add_special_tokens=False)):
                got[w] = self.feed * f + self.pack(e.ids)
        self.memo.update(got)
        for w in got:
            if len(w) > LONGEST_KEPT:
                del self.memo[w]
        return got

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text, without the end id."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_word:
            return [self.pack(e.ids) for e in self.lib.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        if len(self.memo) > MEMO:
            self.memo.clear()
        # a text as words between spaces, the first of each line with a line feed before it
        feed, none = pa.array(["\n", ""], pa.large_string())
        lines = pc.binary_join_element_wise(feed, pc.replace_substring(texts, "\n", " \n"), none)
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.memo.get, words))
        if new := [i for i, p in enumerate(found) if p is None]:
            got = self.learn([words[i] for i in new])
            for i in new:
                found[i] = got[words[i]]
        packed = pa.array(found, pa.large_binary())
        ids = packed.take(coded.indices)
        starts = split.offsets.to_numpy()
        cuts = _offsets(ids)[starts].tolist()
        data, skip = ids.buffers()[2].to_pybytes() if len(ids) else b"", len(self.feed)
        out = [data[a + skip : b] for a, b in zip(cuts, cuts[1:])]
        whole = {i for s in self.specials for i in np.flatnonzero(pc.match_substring(texts, s)).tolist()}
        bad = np.diff(_offsets(packed)) % self.width.itemsize != 0
        if bad.any():
            whole.update((np.searchsorted(starts, np.flatnonzero(bad[coded.indices.to_numpy()]), side="right") - 1).tolist())
        again = sorted(whole)
        for i, e in zip(again, self.lib.encode_batch([texts[i].as_py() for i in again], add_special_tokens=False)):
            out[i] = self.pack(e.ids)
        return out


def _offsets(a: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, 8 * a.offset) if len(a) else np.zeros(1, np.int64)


def groups(columns: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """Texts of batches, put together or cut to groups of about ``GROUP`` bytes."""
    held, size = [], 0
    for texts in columns:
        texts = texts.cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(ends // GROUP)) + 1).tolist(), len(texts)] if len(texts) else []
        for at, end in zip(cuts, cuts[1:]):
            held.append(texts.slice(at, end - at))
            size += int(ends[end - 1]) - (int(ends[at - 1]) if at else 0)
            if size >= GROUP:
                yield pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def encoder(file: str) -> Encoder:
    return keep("token store", file, lambda: Encoder(file))


# --- minimal perfect hash


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class Mph:
    """A minimal perfect hash of distinct int64 keys: levels of bits and ranks."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.starts = np.concatenate(([0], np.cumsum(sizes)))

    @staticmethod
    def build(keys: np.ndarray) -> Mph:
        left, sizes, levels = keys, [], []
        while len(left):
            if len(sizes) == MAX_LEVELS:
                raise RuntimeError("keys are not distinct")
            size = -(-int(GAMMA * len(left) + 1) // 64) * 64
            at = (_hash(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        words = np.packbits(bits, bitorder="little").view("<u8")
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])) if len(words) else np.zeros(0, np.int64)
        return Mph(np.array(sizes, np.int64), words, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that certainly were not there."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = (_hash(keys[todo], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = self.ranks[at[hit] >> 6] + below[hit]
            todo = todo[~hit]
        return out


# --- shards


def _store(where: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(where)


def _put(files: pafs.FileSystem, folder: str, name: str, attempt: str, parts: Iterator[bytes]) -> None:
    """Write a file under another name and rename it when it is complete."""
    part = f"{folder}/.{name}.{attempt}"
    with files.open_output_stream(part) as f:
        for p in parts:
            f.write(p)
    files.move(part, f"{folder}/{name}")


def index_bytes(keys: np.ndarray, n_null: int, offsets: np.ndarray, width: int) -> bytes:
    """The .idx file of rows with these (sorted) keys; ``n_null`` rows without one follow."""
    distinct, first, rows = np.unique(keys, return_index=True, return_counts=True)
    mph = Mph.build(distinct)
    slot = mph.slots(distinct)
    finger, at, n = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    finger[slot], at[slot], n[slot] = fingerprints(distinct), first, rows
    head = np.array([VERSION, width, len(offsets) - 1, len(distinct), n_null, 64 * len(mph.words), len(mph.sizes)], "<i8")
    return MAGIC + b"".join(x.tobytes() for x in (head, mph.sizes.astype("<i8"), offsets.astype("<i8"), finger, at, n, mph.ranks.astype("<i8"), mph.words))


class Shard:
    """One shard opened for keyed access."""

    def __init__(self, files: pafs.FileSystem, folder: str, number: int):
        with files.open_input_stream(f"{folder}/{number:05d}.idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{number:05d}.idx is no token index")
        at = 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        version, width, self.rows, keys, self.n_null, bits, levels = take("<i8", 7).tolist()
        if version != VERSION:
            raise ValueError(f"token index of version {version}")
        sizes = take("<i8", levels)
        self.offsets = take("<i8", self.rows + 1)
        self.finger, self.first, self.n = take("<u4", keys), take("<u4", keys), take("<u4", keys)
        ranks = take("<i8", bits // 64)
        self.mph = Mph(sizes, take("<u8", bits // 64), ranks)
        self.kind = np.dtype(f"<u{width}")
        self.file = files.open_input_file(f"{folder}/{number:05d}.ids")
        self.ahead, self.held, self.held_at = 0, b"", 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of each key that is there: the key's place in ``keys`` and the row."""
        slot = self.mph.slots(keys)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self.finger[slot[hit]] == fingerprints(keys[hit])]
        n, first = self.n[slot[hit]].astype(np.int64), self.first[slot[hit]].astype(np.int64)
        row = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(hit, n), row

    def ids(self, row: int) -> np.ndarray:
        """The ids of a row, from the raw payload."""
        a, b = int(self.offsets[row]) * self.kind.itemsize, int(self.offsets[row + 1]) * self.kind.itemsize
        if a < self.held_at or b > self.held_at + len(self.held):
            self.held, self.held_at = self.file.read_at(max(b - a, min(self.ahead, int(self.offsets[-1]) * self.kind.itemsize - a)), a), a
        return np.frombuffer(self.held, self.kind, (b - a) // self.kind.itemsize, a - self.held_at)


def write(docs: DataFrame, where: str, model: str = MODEL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Tokenise and store ``docs`` (doc_id, text); returns the manifest."""
    spark = docs.sparkSession
    small_batches(spark)
    file = tokenizer_file(model)
    files, folder = _store(where)
    files.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = encoder(file)
        ctx = TaskContext.get()
        files, folder = _store(where)
        name, attempt = f"{ctx.partitionId():05d}", str(ctx.taskAttemptId())
        keys, sizes, nulls = [], [], 0
        end = c.pack([END_ID])

        def column() -> Iterator[pa.Array]:
            nonlocal nulls
            for b in batches:
                nulls += b.column(0).null_count
                keys.append(b.column(0).drop_null().to_numpy(zero_copy_only=False))
                yield b.column(1)

        def payload() -> Iterator[bytes]:
            for texts in groups(column()):
                packed = [p + end for p in c.encode(texts)]
                sizes.append(np.fromiter(map(len, packed), np.int64, len(packed)) // c.width.itemsize)
                yield b"".join(packed)

        head = payload()
        started = next(head, None)
        if started is None:
            return

        def all_parts() -> Iterator[bytes]:
            yield started
            yield from head

        _put(files, folder, f"{name}.ids", attempt, all_parts())
        every = np.concatenate(keys)
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        _put(files, folder, f"{name}.idx", attempt, iter([index_bytes(every, nulls, offsets, c.width.itemsize)]))
        low, high = (int(every[0]), int(every[-1])) if len(every) else (None, None)
        yield pa.record_batch({"shard": pa.array([ctx.partitionId()], pa.int32()), "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64()), "rows": pa.array([len(every) + nulls], pa.int64()), "ids": pa.array([int(offsets[-1])], pa.int64()), "n_null": pa.array([nulls], pa.int64())})

    n = docs.count()
    shards = max(1, -(-n // shard_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_part", F.spark_partition_id())
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("_part")]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    written = saved(ranged.mapInArrow(run, "shard int, low long, high long, rows long, ids long, n_null long"))
    # ids of all shards before each, in blocks of shards
    written = written.withColumn("_block", F.floor(F.col("shard") / BLOCK))
    blocks = written.groupBy("_block").agg(F.sum("ids").alias("_ids"))
    blocks = blocks.select("_block", (F.sum("_ids").over(Window.orderBy("_block")) - F.col("_ids")).alias("_before"))
    within = F.sum("ids").over(Window.partitionBy("_block").orderBy("shard")) - F.col("ids")
    whole = written.withColumn("_in", within).join(blocks, "_block").select("shard", "low", "high", "rows", "ids", "n_null", (F.col("_before") + F.col("_in")).alias("base"))
    whole.orderBy("shard").write.parquet(f"{where.rstrip('/')}/manifest")
    return read_manifest(spark, where)


MANIFEST = "shard int, low long, high long, rows long, ids long, n_null long, base long"


def read_manifest(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{where.rstrip('/')}/manifest")


def _meeting(where: str, wanted: ds.Expression) -> pa.Table:
    """The manifest's rows that fit a condition, by shard, read in a task."""
    files, folder = _store(where)
    return ds.dataset(f"{folder}/manifest", filesystem=files, format="parquet", schema=_MANIFEST_SCHEMA).to_table(filter=wanted).sort_by("shard")


_MANIFEST_SCHEMA = pa.schema([("shard", pa.int32()), *((c, pa.int64()) for c in ("low", "high", "rows", "ids", "n_null", "base"))])


def places(keys: DataFrame, where: str, parts: int) -> DataFrame:
    """(doc_id, shard, base) of every shard that may hold a key: one for most keys, as many as it fills for a hot one."""
    names = ["doc_id", "shard", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, null = [], False
        for b in batches:  # distinct keys of one range: eight bytes each
            null |= b.column(0).null_count > 0
            some.append(b.column(0).drop_null().to_numpy(zero_copy_only=False))
        if null:
            m = _meeting(where, ds.field("n_null") > 0)
            yield pa.RecordBatch.from_arrays([pa.nulls(m.num_rows, pa.int64()), *(m[c].combine_chunks() for c in names[1:])], names=names)
        want = np.concatenate(some) if some else np.zeros(0, np.int64)
        if not len(want):
            return
        m = _meeting(where, (ds.field("low") <= int(want[-1])) & (ds.field("high") >= int(want[0])))
        low, high, shard, base = (m[c].to_numpy() for c in ("low", "high", "shard", "base"))
        first, end = np.searchsorted(high, want), np.searchsorted(low, want, side="right")
        for k in range(int((end - first).max(initial=0))):  # one round but for keys that fill shards
            hit = np.flatnonzero(first + k < end)
            at = first[hit] + k
            yield pa.RecordBatch.from_arrays([pa.array(want[hit]), pa.array(shard[at], pa.int32()), pa.array(base[at])], names=names)

    distinct = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ranged = distinct.repartitionByRange(parts, F.col("doc_id").asc_nulls_last()).sortWithinPartitions("doc_id")
    return ranged.mapInArrow(run, "doc_id long, shard int, base long")


def lookup(keys: DataFrame, where: str, with_ids: bool = False) -> DataFrame:
    """Rows of the store for each key of ``keys`` (doc_id; each distinct key once): doc_id, start, n_tokens, ids_crc32.

    Keys find their shards in the manifest, and each shard is read by one task, so the rows of a key (or without
    one) that fill many shards are read by many tasks.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids

    def rows(s: Shard, base: int, keys: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        s.ahead = READ_AHEAD if 16 * len(at) > s.rows else 0
        for k in range(0, len(at), BATCH_ROWS):
            out: list[tuple] = []
            for key, r in zip(keys[k : k + BATCH_ROWS].tolist(), at[k : k + BATCH_ROWS].tolist()):
                ids = s.ids(r)
                out.append((key, base + int(s.offsets[r]), len(ids), crc_of_ids(ids), *([ids.tolist()] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _store(where)
        s, number = None, -1
        for b in batches:
            shards, bases = b.column(1).to_numpy(), b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for at, end in zip(cuts, cuts[1:]):
                if s is None or number != shards[at]:
                    if s is not None:
                        s.file.close()
                    number = int(shards[at])
                    s = Shard(files, folder, number)
                part = b.column(0).slice(at, end - at)
                if part.null_count:
                    null = np.arange(s.rows - s.n_null, s.rows)
                    for got in rows(s, int(bases[at]), np.zeros(len(null), np.int64), null):
                        yield got.set_column(0, "doc_id", pa.nulls(got.num_rows, pa.int64()))
                want = part.drop_null().to_numpy(zero_copy_only=False)
                which, place = s.find(want)
                yield from rows(s, int(bases[at]), want[which], place)

    shards = max(1, read_manifest(keys.sparkSession, where).count())
    found = places(keys, where, shards).repartition(shards, "shard").sortWithinPartitions("shard", "doc_id")
    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    where = fresh_dir(spark, "token-store")
    write(docs, where)
    return lookup(docs, where)
