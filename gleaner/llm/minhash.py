"""Near-duplicate documents: consistent weighted sampling, banded, verified exactly.

A document is the set of its five-word shingles (lower case; one shingle of all words below
five), each weighted TF-IDF: (1 + ln tf) times a bounded idf. Signatures are drawn by
improved consistent weighted sampling (Ioffe, 2010): for each of the hash functions the shingle and
level that minimise ln c - r (t - beta) - r with t = floor(ln w / r + beta). The triples
(r, c, beta) come from a seeded pool of POOL entries a function, looked up by a hash of the
shingle; equal values are resolved towards the smaller hash, so sampling stays consistent.
BANDS bands of ROWS samples make the candidates: at weighted Jaccard similarity 0.8 a pair is
missed with probability (1 - 0.8^4)^20 < 3e-5. A link is a pair of candidates with weighted
Jaccard similarity >= 0.8 computed from the whole texts; groups are the links' components.

Document frequencies cover all documents, in a count-mean-min sketch of fixed size. Its error is a
constant share of the number of documents, so is the idf's smoothing EPSILON, and the weights
behave alike at every size. The idf is bounded to [IDF_FLOOR, 1] in IDF_STEPS steps: in a
large group of near copies the shared shingles are frequent and the edited ones are not, and an
unbounded idf would push such copies under the threshold.

Exact copies collapse first: what is compared are distinct texts, known by their digest. Texts move
once, only those that share a bucket are kept as shingle sets, and everything after works on
these. Each text is first checked against the smallest text of the bucket that it shares most often,
then components that meet in a bucket are checked by one pair; that connects most of what is
connected. Buckets that still hold several components are compared exactly, in cells of bounded
size: an upper bound of the similarity from binned weights rules pairs out, the others are
computed unless links found in the cell connect them already. So no link between candidates that joins two
components is lost, and neither pairs within a component nor lists of pairs are ever formed.

Defined cases: documents without words (null, empty, white space) link with nothing, each its
own class; rows with a null doc_id are not compared and stay, with a null class; rows that
share a doc_id but not the text are compared as documents of their own, and one row is kept of those that share a class
whose smallest doc_id they have; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, WORD, drop_dir, fresh_dir, keep, saved, small_batches, table
from .links import components, roots

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, POOL = 20, 4, 1 << 14
EPSILON, IDF_FLOOR, IDF_STEPS = 0.002, 0.8, 8
DEPTH, WIDTH = 3, 1 << 16
BINS = 256
#: Members that meet a copy of their head, rows and shingles of a tile.
STAR_ROWS, TILE_ROWS, TILE_SHINGLES = 512, 512, 1 << 20
_CHUNK = 1 << 18
_M = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_S33 = np.uint64(33)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S33)) * _M
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64; kept for texts of the usual length."""
    return keep("minhash", "powers", lambda: _new_powers(n)) if n == _CHUNK + 1 else _new_powers(n)


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word in these bytes, from prefix sums of a polynomial."""
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    size = max(_CHUNK, 1 << int(len(b)).bit_length()) + 1
    up, down = _powers(size)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)))
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text and how often each occurs."""
    b = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    parts, at = [], 0
    while at < len(b):  # cut before a space, so that no word is split
        end = min(at + _CHUNK, len(b))
        if end < len(b):
            gaps = np.flatnonzero(_SPACE[b[at:end]])
            if len(gaps) and gaps[-1]:
                end = at + int(gaps[-1])
            else:
                later = np.flatnonzero(_SPACE[b[end:]])
                end = end + int(later[0]) if len(later) else len(b)
        parts.append(_word_hashes(b[at:end]))
        at = end
    w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = max(1, len(w) - WORDS + 1) if len(w) else 0
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(WORDS, len(w))):
            h = _mixed(h + np.uint64(k + 1)) + w[k : k + n]
        h = _mixed(h)
    return np.unique(h, return_counts=True)


def _buckets(h: np.ndarray, row: int) -> np.ndarray:
    """The sketch's counter of each shingle in one of its rows."""
    return ((h >> np.uint64(16 * row)) & np.uint64(WIDTH - 1)).astype(np.int64)


class Idf:
    """Bounded idf factors from the sketch of document frequencies."""

    def __init__(self, counts: np.ndarray, documents: int):
        self.documents = max(1, documents)
        mean = counts.mean(axis=1, keepdims=True)
        self.share = np.maximum(0.0, (counts - mean) / self.documents).astype(np.float32)

    def factors(self, h: np.ndarray) -> np.ndarray:
        p = self.share[0][_buckets(h, 0)]
        for row in range(1, DEPTH):
            p = np.minimum(p, self.share[row][_buckets(h, row)])
        idf = np.log((1 + EPSILON) / (np.minimum(p, 1) + EPSILON)) / np.log((1 + EPSILON) / EPSILON)
        return IDF_FLOOR + (1 - IDF_FLOOR) * np.rint(idf * IDF_STEPS) / IDF_STEPS


def weighted(text: str | None, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    h, tf = shingles(text)
    return h, (1 + np.log(tf)) * idf.factors(h)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted shingle sets."""
    if not len(x[0]) or not len(y[0]):
        return 0.0
    if len(x[0]) > len(y[0]):
        x, y = y, x
    at = np.searchsorted(y[0], x[0])
    at[at == len(y[0])] = 0
    hit = y[0][at] == x[0]
    shared = float(np.minimum(x[1][hit], y[1][at[hit]]).sum())
    return shared / (float(x[1].sum()) + float(y[1].sum()) - shared)


def _pool() -> tuple[np.ndarray, ...]:
    """Per function and entry: r, ln c, beta; and for weight 1 the value to minimise and t."""
    return keep("minhash", "pool", _new_pool)


def _new_pool() -> tuple[np.ndarray, ...]:
    rng = np.random.Generator(np.random.PCG64(20240607))
    shape = (BANDS * ROWS, POOL)
    r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
    c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
    beta = rng.random(shape, dtype=np.float32)
    odd = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    t = np.floor(beta)
    return r.ravel(), c.ravel(), beta.ravel(), (c - r * (t - beta) - r).ravel(), odd


def signature(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One band key for each band."""
    r, c, beta, value_one, odd = _pool()
    k = BANDS * ROWS
    offset = (np.arange(k, dtype=np.uint64) * np.uint64(POOL))[:, None]
    shift = np.uint64(64 - POOL.bit_length() + 1)
    best = np.full(k, np.inf, np.float32)
    won = np.zeros(k, np.uint64)
    level = np.zeros(k, np.float32)
    lnw = np.log(w).astype(np.float32)
    usual = lnw == 0
    for some, plain in ((usual, True), (~usual, False)):
        hs, ls = h[some], lnw[some]
        for at in range(0, len(hs), 2048):
            part = hs[at : at + 2048]
            index = ((odd[:, None] * part[None, :]) >> shift) + offset
            if plain:
                value, t = value_one[index], None
            else:
                rr, bb = r[index], beta[index]
                t = np.floor(ls[at : at + 2048][None, :] / rr + bb)
                value = c[index] - rr * (t - bb) - rr
            j = value.argmin(axis=1)
            rows = np.arange(k)
            low, key = value[rows, j], part[j]
            better = (low < best) | ((low == best) & (key < won))
            best, won = np.where(better, low, best), np.where(better, key, won)
            level = np.where(better, t[rows, j] if t is not None else np.float32(0), level)
    with np.errstate(over="ignore"):
        sample = _mixed(won + (level.astype(np.int64).astype(np.uint64) * np.uint64(_BASE)))
        bands = sample.reshape(BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            key = _mixed(key + bands[:, i])
    return key.view(np.int64)


def frequencies(docs: DataFrame) -> Idf:
    """The sketch over all documents: each task counts in arrays, Spark adds them up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((DEPTH, WIDTH), np.int64)
        n = 0
        for b in batches:
            found = [shingles(t)[0] for t in b.column(0).to_pylist()]
            n += sum(len(x) > 0 for x in found)
            every = np.concatenate(found) if found else np.zeros(0, np.uint64)
            for row in range(DEPTH):
                sums[row] += np.bincount(_buckets(every, row), minlength=WIDTH)
        live = np.flatnonzero(sums)
        yield pa.record_batch({"at": pa.array(np.append(live, -1).astype(np.int32)), "n": pa.array(np.append(sums.ravel()[live], n))})

    got = docs.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(DEPTH * WIDTH, np.int64)
    live = got[got["at"] >= 0]
    counts[live["at"].to_numpy()] = live["n"].to_numpy()
    return Idf(counts.reshape(DEPTH, WIDTH), int(got.loc[got["at"] < 0, "n"].sum()))


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, digest of the text, number of shingles, band keys) of every document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, digests, sizes, keys = [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, w = weighted(text, idf.value)
                ids.append(doc_id)
                sizes.append(len(h))
                if doc_id is None or not len(h):
                    digests.append(None)
                    keys.append(None)
                else:
                    digests.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
                    keys.append(signature(h, w))
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "digest": pa.array(digests, pa.binary()), "n": pa.array(sizes, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest binary, n long, keys array<long>")


def _digest(text: str) -> F.Column:
    return F.unhex(F.md5(text))


SETS = "v binary, keys array<long>, hashes binary, counts binary, bins binary"


def shingle_sets(docs: DataFrame, wanted: DataFrame, idf) -> DataFrame:
    """Shingles, counts and binned weights of the texts that share a bucket: one move of the texts, by (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null").withColumn("v", _digest("text"))
    texts = texts.join(wanted, ["id", "v"]).select("id", "v", "keys", "text").dropDuplicates(["id", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, counts, bins = [], [], []
            for text in b.column(2).to_pylist():
                h, tf = shingles(text)
                w = (1 + np.log(tf)) * idf.value.factors(h)
                hashes.append(h.astype("<u8").tobytes())
                counts.append(tf.astype("<u4").tobytes())
                bins.append(np.bincount((h >> np.uint64(56)).astype(np.int64), weights=w, minlength=BINS).astype("<f4").tobytes())
            yield pa.record_batch({"v": b.column(0), "keys": b.column(1), "hashes": pa.array(hashes, pa.binary()), "counts": pa.array(counts, pa.binary()), "bins": pa.array(bins, pa.binary())})

    return texts.select("v", "keys", "text").mapInArrow(run, SETS)


def _set(hashes: bytes, counts: bytes, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(hashes, "<u8")
    return h, (1 + np.log(np.frombuffer(counts, "<u4"))) * idf.factors(h)


def star_links(pairs: DataFrame, sets: DataFrame, idf, threshold: float, star_rows: int) -> DataFrame:
    """(x, y) of those pairs (a, head, x, y) whose texts a and head reach the threshold.

    Members meet their head in one sorted pass; a head with many members is copied to as many
    groups as it takes for none to have much more than ``star_rows``.
    """
    pairs = saved(pairs)
    heads = saved(pairs.groupBy("head").agg(F.ceil(F.count("*") / star_rows).cast("int").alias("parts")))
    roles = pairs.join(heads, "head").select("head", F.expr("pmod(xxhash64(a, 5), parts)").cast("int").alias("part"), F.col("a").alias("v"), F.lit(1).alias("role"), "x", "y")
    none = F.lit(None).cast("binary")
    roles = roles.unionByName(heads.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("head").alias("v"), F.lit(0).alias("role"), none.alias("x"), none.alias("y")))
    met = roles.join(sets.select("v", "hashes", "counts"), "v").repartition("head", "part").sortWithinPartitions("head", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for b in batches:
            keep = []
            for role, hashes, counts in zip(*(b.column(c).to_pylist() for c in ("role", "hashes", "counts"))):
                if role == 0:
                    centre = _set(hashes, counts, idf.value)
                keep.append(role == 1 and similarity(_set(hashes, counts, idf.value), centre) >= threshold)
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return saved(met.select("role", "hashes", "counts", "x", "y").mapInArrow(run, "x binary, y binary"))


class _Forest:
    """Which components the links found in one task have joined."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


CELL = ("bucket", "low", "high")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each cell, as columns, of batches sorted by cell."""
    held: dict[str, list] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        place = np.stack([b.column(c).to_numpy() for c in CELL], axis=1)
        cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        columns = {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)}
        for at, end in zip(cuts, cuts[1:]):
            part = {n: c[at:end] for n, c in columns.items()}
            if held is not None and all(held[c][0] == part[c][0] for c in CELL):
                for n, c in part.items():
                    held[n] += c
            else:
                if held is not None:
                    yield held
                held = part
    if held is not None:
        yield held


def compare(rows: dict[str, list], threshold: float, idf: Idf | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Rows of a cell on side 0 against those on side 1 (in a cell of one tile: against each other).

    A pair counts in the first bucket that its texts share, if their components differ and the
    binned weights allow for the threshold. Returned are the rows that have such a pair and, with
    ``idf``, the links among these pairs: a forest, since a pair that links found here connect already is
    not computed.
    """
    n, bucket = len(rows["v"]), rows["bucket"][0]
    bins = np.frombuffer(b"".join(rows["bins"]), "<f4").reshape(n, BINS)
    total = bins.sum(axis=1, dtype=np.float64)
    keys = np.array(rows["keys"], np.int64)
    number: dict[bytes, int] = {}
    comp = np.array([number.setdefault(c, len(number)) for c in rows["comp"]])
    side = np.array(rows["side"])
    left = np.flatnonzero(side == 0)
    one = rows["low"][0] == rows["high"][0]
    right = left if one else np.flatnonzero(side == 1)
    marked = np.zeros(n, bool)
    forest, known, links = _Forest(len(number)), {}, []

    def weights(i: int):
        if i not in known:
            known[i] = _set(rows["hashes"][i], rows["counts"][i], idf)
        return known[i]

    for i in left.tolist():
        r = right[(comp[right] != comp[i]) & ((right > i) if one else True)]
        r = r[np.minimum(total[r], total[i]) >= (threshold - 1e-3) * np.maximum(total[r], total[i])]
        if len(r):
            r = r[keys[r, (keys[r] == keys[i]).argmax(axis=1)] == bucket]
        if len(r):
            shared = np.minimum(bins[r], bins[i]).sum(axis=1, dtype=np.float64)
            r = r[shared >= (threshold - 1e-3) * (total[r] + total[i] - shared)]
        if not len(r):
            continue
        marked[i] = marked[r] = True
        if idf is not None:
            for j in r.tolist():
                if forest.root(comp[i]) != forest.root(comp[j]) and similarity(weights(i), weights(j)) >= threshold:
                    forest.join(comp[i], comp[j])
                    links.append((i, j))
    return np.flatnonzero(marked), links


MARKED = "bucket long, low int, high int, side int, v binary, comp binary"


def possible(cells: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows of cells that may have a link there."""
    names = [x.split()[0] for x in MARKED.split(", ")]
    met = cells.join(sets.select("v", "keys", "bins"), "v").repartition(*CELL).sortWithinPartitions(*CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = {c: [] for c in names}, 0
        for rows in _cells(batches):
            at = compare(rows, threshold)[0].tolist()
            for c in names:
                out[c] += [rows[c][i] for i in at]
            n += len(at)
            if n >= BATCH_ROWS * 16:
                yield _batch(out, names)
                out, n = {c: [] for c in names}, 0
        yield _batch(out, names)

    return met.select(*names, "keys", "bins").mapInArrow(run, MARKED)


def _batch(out: dict[str, list], names: list[str]) -> pa.RecordBatch:
    kinds = dict(zip(names, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())))
    return pa.record_batch({c: pa.array(out[c], kinds[c]) for c in names})


def cell_links(marked: DataFrame, sets: DataFrame, idf, threshold: float) -> DataFrame:
    """Pairs of components that have a link, from the cells' rows that may have one."""
    met = marked.join(sets, "v").repartition(*CELL).sortWithinPartitions(*CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            links = compare(rows, threshold, idf.value)[1]
            if links:
                yield pa.record_batch({"x": pa.array([rows["comp"][i] for i, _ in links], pa.binary()), "y": pa.array([rows["comp"][j] for _, j in links], pa.binary())})

    return met.mapInArrow(run, "x binary, y binary")


def merged(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """Labels (v, comp) after the components' links (x, y)."""
    comp = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("comp"), "component")
    return saved(labels.join(comp, "comp", "left").select("v", F.coalesce("component", "comp").alias("comp")))


def crowded(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (bucket, v, n, comp) of buckets that hold texts of several components."""
    rows = saved(shared.join(labels, "v"))
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return rows.join(mixed, "bucket", "left_semi")


def dealt(rows: DataFrame, tile_rows: int, tile_shingles: int) -> DataFrame:
    """Cells (bucket, low, high) of rows whose components differ: tiles of the bucket's largest component
    meet those of the others, which meet each other as well; no two tiles of the largest one meet."""
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("rows", "comp")).alias("top"), F.sum("rows").alias("rows"), F.sum("all").alias("all"), F.max(F.struct("rows", "comp", "all"))["all"].alias("top_all"))
    tiles = lambda n, m: F.greatest(F.lit(1), F.ceil(n / tile_rows), F.ceil(m / tile_shingles)).cast("int")
    largest = largest.select("bucket", F.col("top.comp").alias("_top"), tiles(F.col("top.rows"), F.col("top_all")).alias("_m"), tiles(F.col("rows") - F.col("top.rows"), F.col("all") - F.col("top_all")).alias("_r"))
    placed = rows.join(largest, "bucket").withColumn("_is", F.col("comp") == F.col("_top"))
    placed = placed.withColumn("_tile", F.when(F.col("_is"), F.expr("pmod(xxhash64(v, 3), _m)")).otherwise(F.expr("_m + pmod(xxhash64(v, 3), _r)")).cast("int"))
    meets = placed.withColumn("_other", F.explode(F.sequence(F.when(F.col("_is"), F.col("_m")).otherwise(F.lit(0)), F.col("_m") + F.col("_r") - 1)))
    return meets.select("bucket", F.least("_tile", "_other").alias("low"), F.greatest("_tile", "_other").alias("high"), (F.col("_tile") > F.col("_other")).cast("int").alias("side"), "v", "comp")


def vertices(marks: DataFrame) -> DataFrame:
    """Texts (v), the smallest doc_id that has each, its shingles' number and band keys."""
    return marks.where("digest is not null").groupBy(F.col("digest").alias("v")).agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))


def text_components(texts: DataFrame, docs: DataFrame, idf, threshold: float, star_rows: int, tile_rows: int, tile_shingles: int) -> DataFrame:
    """(v, comp) of the texts that share a bucket with another; the component is one of its texts."""
    spark = docs.sparkSession
    buckets = texts.select("v", "id", "n", F.explode("keys").alias("bucket"))
    # the first eight bytes tell two texts of a bucket apart
    mark = F.conv(F.hex(F.substring("v", 1, 8)), 16, -10).cast("long")
    held = buckets.select("bucket", mark.alias("m")).groupBy("bucket").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo < hi").select("bucket")
    shared = saved(buckets.join(held, "bucket", "left_semi"))
    folder = fresh_dir(spark, "sets")
    wanted = texts.join(shared.select("v").distinct(), "v", "left_semi").select("id", "v", "keys")
    shingle_sets(docs, wanted, idf).write.parquet(folder, compression="zstd")
    sets = spark.read.schema(SETS).parquet(folder)

    # each text with the smallest of the texts that it most often shares a bucket with: a forest
    shared = shared.select("bucket", "v", "n")
    heads = shared.groupBy("bucket").agg(F.min("v").alias("head"))
    often = shared.join(heads, "bucket").where("v <> head").groupBy("v", "head").agg(F.count("*").alias("k"))
    pairs = often.groupBy(F.col("v").alias("a")).agg(F.max(F.struct("k", "head"))["head"].alias("head"))
    links = star_links(pairs.select("a", "head", F.col("a").alias("x"), F.col("head").alias("y")), sets, idf, threshold, star_rows)
    comp = roots(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    labels = saved(sets.select("v").join(comp.withColumnRenamed("node", "v"), "v", "left").select("v", F.coalesce("component", "v").alias("comp")))
    rows = crowded(shared, labels)

    # components that meet in a bucket, by their smallest texts in it: one pair for two components
    least = rows.groupBy("bucket", "comp").agg(F.min("v").alias("v"), F.count("*").alias("k"))
    top = least.groupBy("bucket").agg(F.max(F.struct("k", "comp", "v")).alias("top")).select("bucket", F.col("top.comp").alias("_comp"), F.col("top.v").alias("head"))
    met = least.join(top, "bucket").where("comp <> _comp").select(F.col("v").alias("a"), "head", F.least("comp", "_comp").alias("x"), F.greatest("comp", "_comp").alias("y"))
    met = met.groupBy("x", "y").agg(F.min(F.struct("a", "head")).alias("p")).select("p.a", "p.head", "x", "y")
    links = star_links(met, sets, idf, threshold, star_rows)
    if not links.isEmpty():
        labels = merged(labels, links)
        rows = crowded(shared, labels)

    # what is still apart within a bucket, exactly: first which rows matter, then only those with their shingles
    marked = saved(possible(dealt(rows, tile_rows, tile_shingles), sets, threshold))
    links = saved(cell_links(marked, sets, idf, threshold))
    if not links.isEmpty():
        labels = merged(labels, links)
    drop_dir(spark, folder)
    return labels


def classes(docs: DataFrame, threshold: float = THRESHOLD, star_rows: int = STAR_ROWS, tile_rows: int = TILE_ROWS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its group), kept, and the text's digest."""
    spark = docs.sparkSession
    small_batches(spark)
    idf = spark.sparkContext.broadcast(frequencies(docs))  # DEPTH x WIDTH numbers
    marks = saved(signatures(docs, idf))
    texts = saved(vertices(marks))
    labels = text_components(texts, docs, idf, threshold, star_rows, tile_rows, tile_shingles)
    linked = labels.join(texts.select("v", "id"), "v")
    firsts = linked.groupBy("comp").agg(F.min(F.struct("id", "v")).alias("first"))
    linked = linked.join(firsts, "comp").select("v", F.col("first.id").alias("_class"), F.col("first.v").alias("_first"))
    final = saved(texts.select("v", "id").join(linked, "v", "left").select(F.col("v").alias("digest"), F.coalesce("_class", "id").alias("_class"), F.coalesce("_first", "v").alias("_first")))
    first = (F.col("doc_id") == F.col("_class")) & (F.col("digest") == F.col("_first"))
    return marks.select("doc_id", "digest").join(final, "digest", "left").select("doc_id", F.coalesce("_class", "doc_id").alias("class_id"), F.coalesce(first, F.lit(True)).alias("kept"), "digest")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays (the one with the smallest doc_id).

    Of rows that repeat doc_id and text one stays, the one whose columns have the smallest hash; rows that
    share a doc_id with different texts are documents of their own. Rows with a null doc_id
    or without words all stay.
    """
    columns = docs.columns
    gone = classes(docs).where("not kept and digest is not null").select(F.col("doc_id").alias("_gleaner_id"), F.col("digest").alias("_gleaner_text")).distinct()
    rows = docs.withColumn("_gleaner_id", F.col("doc_id").cast("long")).withColumn("_gleaner_text", _digest("text")).withColumn("_gleaner_row", F.xxhash64(*columns))
    left = rows.join(gone, ["_gleaner_id", "_gleaner_text"], "left_anti")
    again = F.row_number().over(Window.partitionBy("_gleaner_id", "_gleaner_text").orderBy("_gleaner_row"))
    once = left.withColumn("_gleaner_n", again)
    single = (F.col("_gleaner_n") == 1) | F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return once.where(single).select(*columns)
