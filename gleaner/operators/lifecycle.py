"""Life cycles as table rewrites: sweeps, generations, retention, guarded updates, set stores, imports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def swept(jobs: DataFrame, now: Column, stale: Column) -> DataFrame:
    """``jobs`` (status, finished_at) with ``action``: what a sweep does with each.

    Succeeded and cancelled jobs go a week after their end, dead ones after 30 days; pending jobs that are ``stale`` are
    cancelled, leased ones that are end as dead.
    """
    age = lambda days: F.col("finished_at") < now - F.make_dt_interval(days=F.lit(days))
    action = (
        F.when(F.col("status").isin("succeeded", "cancelled") & age(7), "delete").when((F.col("status") == "dead") & age(30), "delete")
        .when((F.col("status") == "pending") & stale, "cancel").when((F.col("status") == "leased") & stale, "bury").otherwise("keep")
    )
    return jobs.withColumn("action", action)


def missing_coverage(items: DataFrame, covered: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Keys of ``items`` that are neither covered nor waited for by a job: the jobs to seed."""
    return items.select(key).distinct().join(covered.select(key), key, "left_anti").join(jobs.select(key), key, "left_anti")


def generation_states(generations: DataFrame, by: str, least: float) -> DataFrame:
    """``generations`` (generation_id, covered, total and the key ``by``) with ``state``: building, active or retiring.

    A generation may be active once its coverage reaches ``least``; of those of one key the newest is, older
    complete ones retire, incomplete ones go on building.
    """
    ready = (F.col("total") > 0) & (F.col("covered") >= least * F.col("total"))
    newest = F.max(F.when(ready, F.col("generation_id"))).over(Window.partitionBy(by))
    return generations.withColumn("state", F.when(~ready, "building").when(F.col("generation_id") == newest, "active").otherwise("retiring"))


def prunable(generations: DataFrame, references: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Retiring generations that ended ``days`` ago and that nothing refers to."""
    old = generations.where((F.col("state") == "retiring") & (F.col("ended_at") <= now - F.make_dt_interval(days=F.lit(days))))
    return old.join(references.select("generation_id"), "generation_id", "left_anti")


def guarded_update(rows: DataFrame, requests: DataFrame, key: str, version: str = "version") -> DataFrame:
    """(key, outcome, version) of updates that name the version they read: updated, conflict or not_found.

    Of several requests for a row and version the smallest ``request_id`` is served.
    """
    first = requests.withColumn("_k", F.row_number().over(Window.partitionBy(key, "expected").orderBy("request_id")))
    got = first.join(rows.select(key, version), key, "left")
    fits = (F.col(version) == F.col("expected")) & (F.col("_k") == 1)
    outcome = F.when(F.col(version).isNull(), "not_found").when(fits, "updated").otherwise("conflict")
    return got.select("request_id", key, outcome.alias("outcome"), F.when(fits, F.col(version) + 1).otherwise(F.col(version)).alias(version))


def stored_sets(members: DataFrame, key: str, member: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content-addressed sets: (key, digest) of each key's set of members, and the digests that ``known`` lacks."""
    each = F.array_sort(F.collect_set(F.col(member).cast("string")))
    sets = members.groupBy(key).agg(F.sha2(F.concat_ws("\n", each).cast("binary"), 256).alias("digest"))
    return sets, sets.select("digest").distinct().join(known.select("digest"), "digest", "left_anti")


def import_outcomes(archive: DataFrame, existing: DataFrame, owners: DataFrame, policy: str) -> DataFrame:
    """(id, new_id, owner_id, outcome) of an archive's rows: invalid, unmapped, skipped, error, remapped or imported.

    archive: id, owner_id, content; owners: owner_id, new_owner_id. A row whose id exists is handled by ``policy``: error, skip, or
    remap (a new id beyond all there are).
    """
    if policy not in ("error", "skip", "remap"):
        raise ValueError(f"no conflict policy {policy}")
    top = existing.select("id").unionByName(archive.select("id")).agg(F.max("id").alias("_top"))  # one row
    got = archive.join(existing.select("id").withColumn("_there", F.lit(True)), "id", "left").join(owners, "owner_id", "left").crossJoin(F.broadcast(top))
    valid = F.length(F.trim(F.coalesce("content", F.lit("")))) > 0
    clash = {"error": "error", "skip": "skipped", "remap": "remapped"}[policy]
    outcome = F.when(~valid, "invalid").when(F.col("new_owner_id").isNull(), "unmapped").when(F.col("_there"), clash).otherwise("imported")
    new_id = F.when(outcome == "remapped", F.col("_top") + 1 + F.col("id")).when(outcome == "imported", F.col("id"))
    return got.select("id", new_id.alias("new_id"), F.col("new_owner_id").alias("owner_id"), outcome.alias("outcome"))


def packed(rows: DataFrame, by: str, order: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """``rows`` with ``bin``: each key's rows packed in order into bins of bounded number and size.

    A bin closes when the next row would exceed either bound; a row larger than the bound has a bin of its own. A key's rows
    pass through one task in order, as packing demands, but never stand in one row or in memory together: only (key, order, size) is sorted there.
    """
    kinds = [rows.schema[c].dataType for c in (by, order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, n, total = None, -1, 0, 0
        for b in batches:
            bins = []
            for k, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if number < 0 or k != key:
                    key, number, n, total = k, 0, 0, 0
                elif n + 1 > most_rows or total + s > most_size:
                    number, n, total = number + 1, 0, 0
                n, total = n + 1, total + s
                bins.append(number)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bins, pa.int32())], names=[by, order, "bin"])

    sizes = rows.select(by, order, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size")).repartition(by).sortWithinPartitions(by, order)
    bins = sizes.mapInArrow(run, T.StructType([T.StructField(by, kinds[0]), T.StructField(order, kinds[1]), T.StructField("bin", T.IntegerType())]))
    return rows.join(bins, [by, order])
