"""URL filters as a sort-merge range join, in DataFrame functions only.

A rule is (host, path, verdict). It fits its host and all subdomains where the url's path
starts with its own; the longest fitting rule wins (host plus path; then the longer host, then
the rule's text). Canonical keys are ``reversed host labels`` and the path's UTF-8 bytes, so a
rule's path prefix is the key interval ``[path, path + 0xFF)`` under its host.

Steps: distinct (host, path) pairs of the urls; one point for each host suffix that has a rule;
one ordered sweep per suffix and salt over rule starts, points and rule ends. Within a suffix
the intervals nest, so a rule start pushes itself and a rule end pops back to its parent: each
event carries the rule that is on top of the stack after it, and a point takes the last event
before it. A suffix with many urls is dealt over salts, each with its own copy of that suffix's rules.

Defined cases: a null url, or one without ``://``, has an empty host and path and the default
verdict. Repeated urls are judged once and joined back. Rules with a null or empty host or a
null path are ignored, of equal (host, path) the one with the smallest verdict stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
#: Points of one host suffix that one sweep takes; a suffix with more is dealt over several.
SWEEP_POINTS = 128
#: Parts that every suffix is dealt over before its sweeps are known.
PARTS = 32


def parts(url: str = "url") -> list:
    """Host and path columns of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return [F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")]


def _reversed(host) -> F.Column:
    return F.concat_ws(".", F.reverse(F.split(host, r"\.")))


def rule_events(rules: DataFrame) -> DataFrame:
    """Start and end events of the rules by host suffix, each with the rule on top after it."""
    clean = (
        rules.where("host is not null and host <> '' and path is not null")
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .select(_reversed(F.col("host")).alias("suffix"), "path",
                F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("top"))
    )
    # the parent of a rule: the longest proper prefix of its path that is a rule of the same host
    shorter = clean.select("suffix", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).where(F.col("n") < F.length("path"))
    above = (
        shorter.withColumn("prefix", F.expr("substring(path, 1, n)"))
        .join(clean.select("suffix", F.col("path").alias("prefix"), F.col("top").alias("above")), ["suffix", "prefix"])
        .groupBy("suffix", "path").agg(F.max(F.struct("n", "above"))["above"].alias("above"))
    )
    nested = clean.join(above, ["suffix", "path"], "left")
    starts = nested.select("suffix", F.encode("path", "UTF-8").alias("key"), F.lit(0).alias("kind"), F.length("path").alias("depth"), "top")
    # of ends at one key (one prefix extends another by nothing else) the innermost comes first
    ends = nested.select("suffix", F.concat(F.encode("path", "UTF-8"), F.unhex(F.lit("FF"))).alias("key"), F.lit(2), -F.length("path"), F.col("above").alias("top"))
    return starts.union(ends)


def verdicts(urls: DataFrame, rules: DataFrame, default: str = DEFAULT, sweep_points: int = SWEEP_POINTS) -> DataFrame:
    """(host, path, rule, verdict) of every distinct (host, path) in ``urls``."""
    events = rule_events(rules)
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat_ws(".", F.reverse(F.slice(labels, -n, n))))
    # no step meets all points of a suffix: they are dealt by (suffix, part), with a copy of the suffixes for each part
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    points = pairs.where("host <> ''").withColumn("part", F.expr(f"pmod(xxhash64(path, host), {PARTS})").cast("int"))
    points = points.select("host", "path", "part", F.explode(suffixes).alias("suffix")).join(events.select("suffix").distinct().withColumn("part", part), ["suffix", "part"], "left_semi")
    # a sweep takes at least as many points as its suffix has rules, so that copies of the rules stay in proportion
    ruled = events.groupBy("suffix").agg(F.count("*").alias("ruled"))
    salts = points.groupBy("suffix").agg(F.count("*").alias("n")).join(ruled, "suffix").select("suffix", F.ceil(F.col("n") / F.greatest(F.lit(sweep_points), "ruled")).cast("int").alias("salts"))
    dealt = points.join(salts.withColumn("part", part), ["suffix", "part"]).withColumn("salt", F.expr("pmod(xxhash64(host, path), salts)").cast("int"))
    copies = events.join(salts, "suffix").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    none = F.lit(None)
    line = copies.select("suffix", "salt", "key", "kind", "depth", "top", F.lit(True).alias("event"), none.cast("string").alias("host"), none.cast("string").alias("path")).unionByName(
        dealt.select("suffix", "salt", F.encode("path", "UTF-8").alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("depth"), none.cast("struct<size:int,host_size:int,rule:string,verdict:string>").alias("top"), F.lit(False).alias("event"), "host", "path")
    )
    sweep = Window.partitionBy("suffix", "salt").orderBy("key", "kind", "depth").rowsBetween(Window.unboundedPreceding, 0)
    # the state is wrapped so that an empty stack (a null rule) still counts as the last event
    state = F.last(F.when(F.col("event"), F.struct("top")), ignorenulls=True).over(sweep)
    won = line.select("host", "path", "event", state["top"].alias("top")).where("not event and top is not null").groupBy("host", "path").agg(F.max("top").alias("top"))
    return pairs.join(won, ["host", "path"], "left").select("host", "path", F.col("top.rule").alias("rule"), F.coalesce(F.col("top.verdict"), F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, sweep_points: int = SWEEP_POINTS) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits) and verdict."""
    split = pages.select("page_id", *parts("url"))
    return split.join(verdicts(split, rules, default, sweep_points), ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")


def fixed_rules(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(map(str, RULES)) + " as r(host, path, verdict)")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), fixed_rules(spark))


OP9_SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE k = 1
"""
