"""Code-aware operators over pre-parsed artifact tables: import and re-export resolution, callers, drift, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved

#: Extensions tried for a bare import, and those of a folder's index.
FILE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "css", "html")
INDEX_EXTENSIONS = ("ts", "tsx", "js", "jsx")


def joined_path(base: Column, target: Column) -> Column:
    """``target`` taken from ``base``'s folder, dots resolved; null if it leaves the root."""
    parts = F.filter(F.concat(F.slice(F.split(base, "/"), 1, F.size(F.split(base, "/")) - 1), F.split(target, "/")), lambda p: ~p.isin("", "."))
    out = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(acc.isNull() | ((p == "..") & (F.size(acc) == 0)), F.lit(None).cast("array<string>")).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.when(out.isNotNull(), F.concat_ws("/", out))


def import_candidates(base: Column, target: Column) -> Column:
    """Paths that a relative import may mean; none for other imports or beyond the root."""
    path = joined_path(base, target)
    ext = F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1)
    stem = F.regexp_replace(path, r"\.js$", "")
    with_ext = F.when(ext == ".js", F.array(path, F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")))).otherwise(F.array(path))
    bare = F.array(path, *(F.concat(path, F.lit(f".{e}")) for e in FILE_EXTENSIONS), *(F.concat(path, F.lit(f"/index.{e}")) for e in INDEX_EXTENSIONS))
    none = F.array().cast("array<string>")
    return F.when(~target.startswith(".") | path.isNull(), none).when(ext != "", with_ext).otherwise(F.array_distinct(bare))


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import columns, resolution, to_path): one candidate among ``files`` (path) resolves, several are ambiguous."""
    keys = imports.columns
    cand = imports.withColumn("to", F.explode(import_candidates(F.col("from_path"), F.col("target")))).join(files.select(F.col("path").alias("to")), "to", "left_semi")
    found = cand.groupBy(*keys).agg(F.countDistinct("to").alias("n"), F.min("to").alias("to"))
    got = imports.join(found, keys, "left")
    n = F.coalesce("n", F.lit(0))
    return got.select(*keys, F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("resolution"), F.when(n == 1, F.col("to")).alias("to_path"))


def export_closure(symbols: DataFrame, bindings: DataFrame, depth: int = 32) -> DataFrame:
    """(path, name, to_path, to_name): every symbol that a module exports, directly or through re-exports.

    symbols (path, name); bindings (path, kind, exported, imported, target) of kind ``named`` or ``all``. Facts
    only ever grow and are kept distinct, so cycles end by themselves: rounds go on until nothing is new, ``depth`` at most.
    """
    known = symbols.select("path", "name", F.col("path").alias("to_path"), F.col("name").alias("to_name")).distinct()
    known = saved(known)
    fresh, b = known, saved(bindings)
    for _ in range(depth):
        step = fresh.join(b.withColumnRenamed("path", "via"), F.col("path") == F.col("target"))
        named = step.where("kind = 'named' and imported = name").select(F.col("via").alias("path"), F.col("exported").alias("name"), "to_path", "to_name")
        every = step.where("kind = 'all' and name <> 'default'").select(F.col("via").alias("path"), "name", "to_path", "to_name")
        fresh = saved(named.unionByName(every).distinct().join(known, known.columns, "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
    raise RuntimeError(f"re-exports are still open after {depth} rounds")


def drift_state(candidates: DataFrame, cited: DataFrame, most: int = 3) -> DataFrame:
    """(evidence_id, state) of each citation from its prioritised candidates (at most ``most`` count).

    candidates: evidence_id, priority, same_path, same_content, identity, suffix (booleans). First match wins:
    one candidate of same path and content is current; one of same content moved; several of same content, or of identity,
    ambiguous; one identity changed; a declaration with the cited suffix elsewhere ambiguous; one of same path
    changed; several ambiguous; else deleted.
    """
    # candidates of one id differ in their flags at most: reruns agree whatever order they are read in
    flags = [F.desc(c) for c in ("same_path", "same_content", "identity", "suffix")]
    k = F.row_number().over(Window.partitionBy("evidence_id").orderBy("priority", "candidate_id", *flags))
    top = candidates.withColumn("k", k).where(F.col("k") <= most)
    n = lambda c: F.count(F.when(F.col(c) if isinstance(c, str) else c, 1))
    counts = top.groupBy("evidence_id").agg(n(F.col("same_path") & F.col("same_content")).alias("here"), n("same_content").alias("content"), n("identity").alias("ident"), F.bool_or("suffix").alias("suffix"), n("same_path").alias("path"))
    state = (
        F.when(F.col("here") == 1, "current").when(F.col("content") == 1, "moved").when((F.col("content") > 1) | (F.col("ident") > 1), "ambiguous").when(F.col("ident") == 1, "changed")
        .when(F.col("suffix"), "ambiguous").when(F.col("path") == 1, "changed").when(F.col("path") > 1, "ambiguous").otherwise("deleted")
    )
    return cited.select("evidence_id").join(counts, "evidence_id", "left").select("evidence_id", F.coalesce(F.when(F.col("here").isNotNull(), state), F.lit("deleted")).alias("state"))


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """(subject, verdict) from dependencies (subject, kind, target, resolution, digest) of two revisions.

    Changed digests are *affected*; a dependency on one side only, or resolved otherwise, *possibly_affected*; what cannot
    be compared *unknown*; else *unaffected*; of several the first in this order.
    """
    b = before.select("subject", "kind", "target", F.col("resolution").alias("r0"), F.col("digest").alias("d0"), F.lit(1).alias("i0"))
    a = after.select("subject", "kind", "target", F.col("resolution").alias("r1"), F.col("digest").alias("d1"), F.lit(1).alias("i1"))
    both = b.join(a, ["subject", "kind", "target"], "full")
    rank = (
        F.when(F.col("i0").isNull() | F.col("i1").isNull() | (F.col("r0") != F.col("r1")), 2)
        .when(F.col("d0").isNotNull() & F.col("d1").isNotNull() & (F.col("d0") != F.col("d1")), 3)
        .when((F.col("r0") != "resolved") | F.col("d0").isNull() | F.col("d1").isNull(), 1).otherwise(0)
    )
    return both.groupBy("subject").agg(F.max(rank).alias("r")).select("subject", F.when(F.col("r") == 3, "affected").when(F.col("r") == 2, "possibly_affected").when(F.col("r") == 1, "unknown").otherwise("unaffected").alias("verdict"))


def this_candidates(symbol: Column, parent: Column) -> Column:
    """The names that ``this.x`` may stand for in a parent symbol: itself, x, parent.x; other symbols stand for themselves."""
    member = F.substring(symbol, F.lit(6), F.length(symbol))
    return F.when(symbol.startswith("this."), F.array_distinct(F.array(symbol, member, F.concat(parent, F.lit("."), member)))).otherwise(F.array(symbol))
