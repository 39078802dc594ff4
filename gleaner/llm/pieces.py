"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds all pieces of a SentencePiece model file (never trained here). A text is
read once; at each position the automaton's output links give every piece that ends there,
and each is relaxed against the best path at the place where it begins:

- unigram models: the path with the highest sum of piece scores;
- BPE models: merges, not sums, define the encoding. A sequence of pieces is the encoding exactly
  if each two neighbours are the encoding of their own concatenation, and of all pieces that end at a
  position exactly one continues the encoding before it that way. So a piece is relaxed if it forms
  such a pair with the last piece of the path where it begins (*compatible*, memoised), and the single
  pass gives the library's own result.

No piece of these models holds a space mark after another character, so a text falls apart
before each marked word and around unknown characters; words met before come from a bounded memo.

Decoding joins pieces, turns marks into spaces, drops the dummy prefix and puts byte pieces
together again (invalid bytes become U+FFFD).

Defined cases: null and empty texts have no ids and decode to the empty text; characters without a
piece become byte pieces (models with byte fallback) or the unknown id; the space mark U+2581 in a
text is read as a space, as SentencePiece does; null or repeated doc_ids pass row by row;
extra columns are ignored by ``encode``.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, small_batches, table, tokenizer_file

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words and pairs of pieces that a Python worker remembers at most.
MEMO = 1 << 18
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: A character without a piece costs a unigram path the lowest score and this much.
_UNKNOWN_COST = 10.0


class Codec:
    """Encoder and decoder of one SentencePiece model."""

    def __init__(self, file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        kinds = [p.type for p in model.pieces]
        if trainer.model_type not in (_UNIGRAM, _BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix or _USER in kinds:
            raise ValueError("only unigram and BPE models without normalisation rules or user-defined pieces")
        self.bpe = trainer.model_type == _BPE
        self.prefix = norm.add_dummy_prefix
        self.text_of = [p.piece for p in model.pieces]
        self.sizes = [len(p.piece) for p in model.pieces]
        self.score = [p.score for p in model.pieces]
        self.kind = kinds
        self.unknown = kinds.index(_UNKNOWN)
        self.unk_surface = trainer.unk_surface
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.chars = {p for p in self.id_of if len(p) == 1}
        self.width = np.dtype("<u2" if len(kinds) <= 1 << 16 else "<u4")
        self.lowest = min((self.score[i] for i in self.id_of.values()), default=0.0) - _UNKNOWN_COST
        self.rank_of = {p: -self.score[i] for p, i in self.id_of.items()}  # the lowest merges first
        self.machine = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.machine.add_word(p, (i, len(p)))
        self.machine.make_automaton()
        self.pairs: dict[int, bool] = {}  # of two ids in one number
        self.spines: dict[int, tuple[bool, list[str], list[str]]] = {}
        self.alone: list[bool | None] = [None] * len(kinds)  # whether a piece is its own encoding
        self.memo: dict[str, bytes] = {}
        # whether texts fall apart before marked words and line feeds: no piece crosses such a place
        self.by_word = self.prefix and bool(self.byte) and "\n" not in self.chars and all(MARK not in p.lstrip(MARK) and self.chars.issuperset(p) for p in self.id_of)
        self.is_byte = np.array([k == _BYTE for k in kinds])
        self.high = np.array([i in self.byte_of and self.byte_of[i] > 127 for i in range(len(kinds))])
        self.surface = [chr(self.byte_of[i]) if i in self.byte_of else "" if k == _CONTROL else self.unk_surface if k == _UNKNOWN else p.replace(MARK, " ") for i, (p, k) in enumerate(zip(self.text_of, kinds))]

    def merged(self, s: str) -> tuple[list[str], list[str], list[str]]:
        """The BPE of a short string by its definition; what its first and last symbol were on the way."""
        parts = list(s)
        left, right = [parts[0]], [parts[-1]]
        rank = [self.rank_of.get(x + y, inf) for x, y in zip(parts, parts[1:])]
        while rank and (best := min(rank)) < inf:
            i = rank.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i:
                rank[i - 1] = self.rank_of.get(parts[i - 1] + parts[i], inf)
            else:
                left.append(parts[0])
            if i < len(rank):
                rank[i] = self.rank_of.get(parts[i] + parts[i + 1], inf)
            else:
                right.append(parts[-1])
        return parts, left, right

    def spine(self, k: int) -> tuple[bool, list[str], list[str]]:
        """Whether piece k is its own encoding; its first and last symbols as merging goes on."""
        found = self.spines.get(k)
        if found is None:
            parts, left, right = self.merged(self.text_of[k])
            found = self.spines[k] = (len(parts) == 1, left, right)
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the concatenation of pieces a and b is a, b."""
        (ok_a, _, ends), (ok_b, starts, _) = self.spine(a), self.spine(b)
        found = ok_a and ok_b
        if found:
            ids = self.id_of
            for x in ends:
                for y in starts:
                    if x + y in ids:
                        found = self.merged(self.text_of[a] + self.text_of[b])[0] == [self.text_of[a], self.text_of[b]]
                        break
                else:
                    continue
                break
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        self.pairs[a << 20 | b] = found
        return found

    def path(self, s: str) -> list[int]:
        """Ids of a marked string by the single pass over it."""
        n = len(s)
        last: list[int] = [-1] * (n + 1)  # the piece that ends here; -1: an unknown character
        if self.bpe:
            pairs, chars, alone = self.pairs.get, self.chars, self.alone
            for end, (k, size) in self.machine.iter(s):
                end += 1
                if last[end] >= 0:
                    continue
                at = end - size
                before = last[at]
                if before >= 0:
                    fits = pairs(before << 20 | k)
                    if fits is None:
                        fits = self.compatible(before, k)
                elif at and s[at - 1] in chars:
                    continue
                else:  # the text's start, or an unknown character before, which takes part in no merge
                    fits = alone[k]
                    if fits is None:
                        fits = alone[k] = self.spine(k)[0]
                if fits:
                    last[end] = k
        else:
            best = [0.0] + [None] * n
            done = 0  # places up to here are final

            def settle(to: int) -> None:
                nonlocal done
                while done < to:
                    done += 1
                    step = best[done - 1] + self.lowest
                    if best[done] is None:
                        best[done], last[done] = step, -1

            for end, (k, size) in self.machine.iter(s):
                settle(end)
                score = best[end + 1 - size] + self.score[k]
                if best[end + 1] is None or score > best[end + 1]:
                    best[end + 1], last[end + 1] = score, k
            settle(n)
        out: list[int] = []
        sizes = self.sizes
        while n:
            k = last[n]
            if k >= 0:
                out.append(k)
                n -= sizes[k]
            else:
                if self.byte:
                    out += [self.byte[b] for b in reversed(s[n - 1].encode("utf-8", "surrogatepass"))]
                elif not out or out[-1] != self.unknown:  # a run of unknown characters is one id
                    out.append(self.unknown)
                n -= 1
        return out[::-1]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed as little-endian numbers of ``width``."""
        if not self.by_word:
            return [self.packed(self.path((MARK if self.prefix else "") + t.replace(" ", MARK))) if t else b"" for t in texts]
        get, memo = self.memo.get, self.memo
        out = []
        for t in texts:
            # a space stands for the dummy prefix, and one is put before each line feed to split there
            words = f" {t}".replace(MARK, " ").replace("\n", " \n").split(" ")[1:] if t else []
            if "" in words:
                words = self.runs(words)
            found = list(map(get, words))
            if None in found:
                for i, v in enumerate(found):
                    if v is None:
                        w = words[i]
                        v = get(w)
                        if v is None:
                            if len(memo) >= MEMO:
                                memo.clear()
                            v = memo[w] = self.packed(self.path(w if w[0] in ("\n", MARK) else MARK + w))
                        found[i] = v
            out.append(b"".join(found))
        return out

    def runs(self, words: list[str]) -> list[str]:
        """The words with empty ones, which runs of spaces leave, put as marks before the next word."""
        out: list[str] = []
        marks = 0
        for w in words:
            if not w:
                marks += 1
            elif marks and w[0] == "\n":
                out += [MARK * marks, w]
                marks = 0
            else:
                out.append(MARK * (marks + 1) + w if marks else w)
                marks = 0
        if marks:
            out.append(MARK * marks)
        return out

    def packed(self, ids: list[int]) -> bytes:
        assert sys.byteorder == "little"
        return array(self.width.char, ids).tobytes()

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        ids = np.asarray(ids, np.int64)
        if not self.high[ids].any():
            text = "".join(map(self.surface.__getitem__, ids.tolist()))
        else:
            out, pending = [], bytearray()
            for k in ids.tolist():
                if (b := self.byte_of.get(k)) is not None:
                    pending.append(b)
                    continue
                out += [_bytes_text(bytes(pending)), self.surface[k]]
                pending.clear()
            text = "".join([*out, _bytes_text(bytes(pending))])
        if self.prefix and text[:1] == " ":
            first = next(k for k in ids.tolist() if self.kind[k] != _CONTROL)
            if self.kind[first] == _NORMAL:
                return text[1:]
        return text

    def restores(self, text: str | None, ids: np.ndarray) -> bool:
        """Whether the ids decode to the text (its space marks read as spaces)."""
        return self.decode(ids) == (text or "").replace(MARK, " ")


def _bytes_text(b: bytes) -> str:
    """Bytes as UTF-8; each byte that is no part of a character becomes U+FFFD."""
    out = []
    while b:
        try:
            out.append(b.decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out += [b[: e.start].decode("utf-8"), "\ufffd"]
            b = b[e.start + 1 :]
    return "".join(out)


def codec(file: str) -> Codec:
    """The codec of a model file, built once a Python worker."""
    return keep("pieces", file, lambda: Codec(file))


#: Columns that encoding adds.
ADDED = ("ids", "n_tokens", "ids_crc32", "n_byte_tokens", "restored")


def encode(docs: DataFrame, model: str = MODEL, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with ``ids``, their number, crc32, byte pieces and whether they decode to the text."""
    where = tokenizer_file(model)
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(where)
        for b in batches:
            texts = b.column(k).to_pylist()
            packed = c.encode(texts)
            sizes = np.fromiter((len(p) // c.width.itemsize for p in packed), np.int64, len(packed))
            ids = np.frombuffer(b"".join(packed), c.width).astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            cut = [ids[ends[i] : ends[i + 1]] for i in range(len(packed))]
            same = [c.restores(t, x) for t, x in zip(texts, cut)]
            cols = [*b.columns[:k], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(sizes), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64())]
            cols += [pa.array([int(c.is_byte[x].sum()) for x in cut], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*carry, *ADDED])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(run, f"{kinds}, ids array<int>, n_tokens long, ids_crc32 long, n_byte_tokens long, restored boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of ``encoded`` but ``ids``, and the ``text`` that they stand for."""
    where = tokenizer_file(model)
    others = [c for c in encoded.columns if c not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(where)
        for b in batches:
            texts = [c.decode(x or ()) for x in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*others, "text"])

    kinds = "".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}, " for c in others)
    return encoded.select(*others, "ids").mapInArrow(run, f"{kinds}text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return encode(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: every row's token ids, with the columns that describe it.

    The text goes, and so do columns that have the name of one that encoding adds.
    """
    small_batches(spark)
    return encode(docs, carry=tuple(c for c in docs.columns if c != "text" and c not in ADDED))
