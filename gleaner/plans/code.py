"""Code-aware queries: search over parts as artifacts, dependency graphs over lineitem, small source trees inline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code_graph as C
from ..operators import ranking as R
from ..operators import retrieval as S
from ..sources.tables import table
from .registry import ORACLE_SQL, query

def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_SOURCES = """f AS (SELECT 'src/' || lower(split_part(p_type, ' ', 1)) || '/' || (p_partkey % 40) || CASE p_size % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' WHEN 3 THEN '.css' WHEN 4 THEN '/index.ts' ELSE '/index.jsx' END AS path FROM part),
i AS (SELECT DISTINCT 'src/' || lower(split_part(p_type, ' ', 1)) || '/from.ts' AS from_path, CASE p_partkey % 5 WHEN 0 THEN './' || (p_partkey % 47) WHEN 1 THEN '../' || lower(split_part(p_type, ' ', 1)) || '/' || (p_partkey % 43) WHEN 2 THEN './' || (p_partkey % 41) || '.js' WHEN 3 THEN 'package-' || p_size ELSE '../../../' || p_size END AS target FROM part)"""


@query("import_resolution", rf"""WITH {_SOURCES}, d AS (SELECT from_path, target, CASE WHEN target LIKE './%' THEN regexp_replace(from_path, '/[^/]*$', '') || substr(target, 2) WHEN target LIKE '../../../%' OR target NOT LIKE '.%' THEN NULL ELSE 'src/' || substr(target, 4) END AS base FROM i),
e(suffix) AS (VALUES (''), ('.ts'), ('.tsx'), ('.js'), ('.jsx'), ('.css'), ('.html'), ('/index.ts'), ('/index.tsx'), ('/index.js'), ('/index.jsx')),
c AS (SELECT from_path, target, base || suffix AS path FROM d, e WHERE base NOT LIKE '%.js' UNION ALL SELECT from_path, target, unnest([base, regexp_replace(base, '\.js$', '.ts'), regexp_replace(base, '\.js$', '.tsx')]) FROM d WHERE base LIKE '%.js'),
g AS (SELECT from_path, target, count(DISTINCT c.path) AS n, min(c.path) AS path FROM c WHERE c.path IN (SELECT path FROM f) GROUP BY 1, 2)
SELECT i.from_path, i.target, CASE WHEN coalesce(n, 0) = 0 THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, CASE WHEN n = 1 THEN path END AS to_path FROM i LEFT JOIN g USING (from_path, target)""")
def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A source tree and its relative imports, named after the parts."""
    p = table(spark, d, "part")
    kind = F.lower(F.split("p_type", " ")[0])
    k, size = F.col("p_partkey"), F.col("p_size")
    case = lambda by, values: F.element_at(F.array(*values), (by % len(values) + 1).cast("int"))
    suffix = case(size, [F.lit(x) for x in (".ts", ".tsx", ".js", ".css", "/index.ts", "/index.jsx")])
    files = p.select(F.concat(F.lit("src/"), kind, F.lit("/"), (k % 40).cast("string"), suffix).alias("path"))
    target = case(k, [F.concat(F.lit("./"), (k % 47).cast("string")), F.concat(F.lit("../"), kind, F.lit("/"), (k % 43).cast("string")), F.concat(F.lit("./"), (k % 41).cast("string"), F.lit(".js")), F.concat(F.lit("package-"), size.cast("string")), F.concat(F.lit("../../../"), size.cast("string"))])
    imports = p.select(F.concat(F.lit("src/"), kind, F.lit("/from.ts")).alias("from_path"), target.alias("target")).distinct()
    return C.resolved_imports(imports, files)


_EXPORTS = """s AS (SELECT DISTINCT 'm' || (p_size % 10) AS path, CASE WHEN p_partkey % 9 = 0 THEN 'default' ELSE lower(split_part(p_name, ' ', 1)) END AS name FROM part),
b AS (SELECT DISTINCT 'm' || (n_nationkey % 14) AS path, CASE WHEN n_nationkey % 3 = 0 THEN 'all' ELSE 'named' END AS kind, CASE WHEN n_nationkey % 3 <> 0 THEN lower(n_name) END AS exported, CASE WHEN n_nationkey % 3 <> 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'default' ELSE (SELECT min(name) FROM s WHERE name <> 'default') END END AS imported, 'm' || ((n_nationkey * 3 + 1) % 14) AS target FROM nation)"""


@query("reexport_closure", f"""WITH RECURSIVE {_EXPORTS}, x(path, name, to_path, to_name) AS (SELECT path, name, path, name FROM s UNION
SELECT b.path, CASE WHEN b.kind = 'named' THEN b.exported ELSE x.name END, x.to_path, x.to_name FROM x JOIN b ON b.target = x.path WHERE (b.kind = 'named' AND b.imported = x.name) OR (b.kind = 'all' AND x.name <> 'default')) SELECT * FROM x""")
def reexport_closure(spark: SparkSession, d: str) -> DataFrame:
    """Modules whose symbols are the parts' names and whose re-exports, cycles among them, follow the nations."""
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    symbols = p.select(F.concat(F.lit("m"), (F.col("p_size") % 10).cast("string")).alias("path"), F.when(F.col("p_partkey") % 9 == 0, "default").otherwise(F.lower(F.split("p_name", " ")[0])).alias("name")).distinct()
    first = symbols.where("name <> 'default'").agg(F.min("name").alias("first"))  # one row
    k = F.col("n_nationkey")
    named = k % 3 != 0
    bindings = n.crossJoin(F.broadcast(first)).select(
        F.concat(F.lit("m"), (k % 14).cast("string")).alias("path"), F.when(named, "named").otherwise("all").alias("kind"), F.when(named, F.lower("n_name")).alias("exported"),
        F.when(named, F.when(k % 2 == 0, "default").otherwise(F.col("first"))).alias("imported"), F.concat(F.lit("m"), ((k * 3 + 1) % 14).cast("string")).alias("target"),
    ).distinct()
    return C.export_closure(symbols, bindings)


_CODE_Q = ((1, "green"), (2, "blue"), (3, "steel"), (4, "1"))


def _code_search(spark: SparkSession, d: str, lexical: bool) -> DataFrame:
    """Weighted fusion of symbol, literal and path channels, and of the lexical one if wanted; the queries are a small fixed set."""
    q = F.broadcast(spark.createDataFrame(_CODE_Q, "query_id long, q string"))  # four rows
    a = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol"), F.concat_ws("/", "p_type", "p_brand").alias("path"), F.concat_ws(" ", "p_name", "p_type").alias("content"))
    low = lambda c: F.lower(F.col(c))
    hit = lambda c: a.join(q, F.instr(low(c), low("q")) > 0)
    channels = [
        R.ranked(hit("symbol"), F.desc(low("symbol") == low("q")), low("symbol"), F.col("path"), F.col("id"), limit=400).withColumn("channel", F.lit("symbol")).withColumn("w", F.lit(4.0)),
        R.ranked(hit("content"), F.col("path"), F.col("id"), limit=400).withColumn("channel", F.lit("literal")).withColumn("w", F.lit(2.0)),
        R.ranked(hit("path"), F.desc(low("path") == low("q")), F.instr(low("path"), low("q")), F.col("path"), F.col("id"), limit=400).withColumn("channel", F.lit("path")).withColumn("w", F.lit(1.5)),
    ]
    every = channels[0].unionByName(channels[1]).unionByName(channels[2])
    if lexical:
        asked = S.query_terms(q, "q")
        found = S.strict(S.postings(a, wanted=asked), asked).join(a.select("id", "path"), "id")
        word = R.ranked(found, F.desc(F.round("score", 9)), F.col("path"), F.col("id"), limit=400).withColumn("channel", F.lit("lexical")).withColumn("w", F.lit(1.0))
        every = every.select("query_id", "id", "rank", "channel", "w").unionByName(word.select("query_id", "id", "rank", "channel", "w"))
    return every.groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") / (60 + F.col("rank"))), 6).alias("score"), F.concat_ws(",", F.array_sort(F.collect_list("channel"))).alias("channels"))


@query("code_search_rrf", f"""WITH q(query_id, text) AS (VALUES {_values(_CODE_Q)}), a AS (SELECT p_partkey AS id, p_name AS symbol, p_type || '/' || p_brand AS path, p_name || ' ' || p_type AS content FROM part),
c AS (SELECT query_id, id, 'symbol' AS channel, 4.0 AS w, row_number() OVER (PARTITION BY query_id ORDER BY lower(symbol) = lower(text) DESC, lower(symbol), path, id) AS rank FROM a JOIN q ON contains(lower(symbol), lower(text))
UNION ALL SELECT query_id, id, 'literal', 2.0, row_number() OVER (PARTITION BY query_id ORDER BY path, id) FROM a JOIN q ON contains(lower(content), lower(text))
UNION ALL SELECT query_id, id, 'path', 1.5, row_number() OVER (PARTITION BY query_id ORDER BY lower(path) = lower(text) DESC, instr(lower(path), lower(text)), path, id) FROM a JOIN q ON contains(lower(path), lower(text)))
SELECT CAST(query_id AS BIGINT) AS query_id, id, round(sum(w / (60 + rank)), 6) AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM c WHERE rank <= 400 GROUP BY 1, 2""")
def code_search_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _code_search(spark, d, lexical=False)


_CODE_WORDS = r"""SELECT query_id, id, 'lexical', 1.0, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(tf / (tf + 1)), 9) DESC, path, id)
FROM (SELECT id, path, term, count(*) AS tf FROM (SELECT id, path, unnest(regexp_extract_all(lower(content), '([\p{L}\p{N}][\p{L}\p{N}_''-]*)', 1)) AS term FROM a) GROUP BY 1, 2, 3) JOIN q ON term = lower(text) GROUP BY query_id, id, path"""


@query("code_search", ORACLE_SQL["code_search_rrf"].replace(")\nSELECT CAST", f"\nUNION ALL {_CODE_WORDS})\nSELECT CAST"))
def code_search(spark: SparkSession, d: str) -> DataFrame:
    return _code_search(spark, d, lexical=True)


@query("symbol_lookup", """SELECT b.brand, CASE WHEN count(p_partkey) = 0 THEN 'not_found' WHEN count(DISTINCT p_type) > 1 THEN 'ambiguous' ELSE 'ok' END AS outcome, count(p_partkey) AS n FROM (SELECT DISTINCT p_brand AS brand FROM part UNION SELECT 'Brand#none') b LEFT JOIN part ON p_brand = b.brand GROUP BY 1""")
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_partkey", "p_type")
    wanted = p.select("brand").union(spark.createDataFrame([("Brand#none",)], "brand string")).distinct()
    n = F.count("p_partkey")
    return wanted.join(p, "brand", "left").groupBy("brand").agg(F.when(n == 0, "not_found").when(F.countDistinct("p_type") > 1, "ambiguous").otherwise("ok").alias("outcome"), n.alias("n"))


@query("callers_callees", """WITH e AS (SELECT DISTINCT l_suppkey AS caller, l_partkey AS callee FROM lineitem), o AS (SELECT caller AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT callee AS id, count(*) AS n FROM e GROUP BY 1)
SELECT 'callees' AS direction, id, least(n, 25) AS listed, n > 25 AS truncated FROM o UNION ALL SELECT 'callers', id, least(n, 25), n > 25 FROM i""")
def callers_callees(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee")).distinct()
    side = lambda name, key: e.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("direction"), "id", F.least(F.col("n"), F.lit(25)).alias("listed"), (F.col("n") > 25).alias("truncated"))
    return side("callees", "caller").unionByName(side("callers", "callee"))


@query("drift_classification", """WITH c AS (SELECT l_orderkey AS evidence_id, l_partkey * 1000 + l_linenumber AS candidate_id, l_linenumber % 3 AS priority, l_returnflag = 'R' AS same_path, l_linestatus = 'F' AND l_tax > 0.04 AS same_content, l_quantity > 38 AS identity, l_discount > 0.08 AS suffix FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY priority, candidate_id) AS k FROM c), n AS (SELECT evidence_id, count(*) FILTER (WHERE same_path AND same_content) AS here, count(*) FILTER (WHERE same_content) AS content, count(*) FILTER (WHERE identity) AS ident, bool_or(suffix) AS suffix, count(*) FILTER (WHERE same_path) AS path FROM k WHERE k <= 3 GROUP BY 1)
SELECT o_orderkey AS evidence_id, CASE WHEN here IS NULL THEN 'deleted' WHEN here = 1 THEN 'current' WHEN content = 1 THEN 'moved' WHEN content > 1 OR ident > 1 THEN 'ambiguous' WHEN ident = 1 THEN 'changed' WHEN suffix THEN 'ambiguous' WHEN path = 1 THEN 'changed' WHEN path > 1 THEN 'ambiguous' ELSE 'deleted' END AS state FROM orders LEFT JOIN n ON evidence_id = o_orderkey""")
def drift_classification(spark: SparkSession, d: str) -> DataFrame:
    """Orders as citations, their lines as candidates."""
    return drift_of(table(spark, d, "lineitem"), table(spark, d, "orders").select(F.col("o_orderkey").alias("evidence_id")))


def drift_of(lines: DataFrame, cited: DataFrame) -> DataFrame:
    flag = lambda c, name: c.alias(name)
    cand = lines.select(
        F.col("l_orderkey").alias("evidence_id"), (F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("candidate_id"), (F.col("l_linenumber") % 3).alias("priority"), flag(F.col("l_returnflag") == "R", "same_path"),
        flag((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.04), "same_content"), flag(F.col("l_quantity") > 38, "identity"), flag(F.col("l_discount") > 0.08, "suffix"),
    )
    return C.drift_state(cand, cited)


@query("contextual_impact", """WITH b AS (SELECT l_suppkey AS subject, l_partkey AS target, min(l_returnflag) AS d FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-06-01' GROUP BY 1, 2), a AS (SELECT l_suppkey AS subject, l_partkey AS target, max(l_returnflag) AS d FROM lineitem WHERE l_shipdate > TIMESTAMP '1993-01-01' GROUP BY 1, 2),
r AS (SELECT subject, CASE WHEN a.d IS NULL OR b.d IS NULL THEN 2 WHEN a.d <> b.d THEN 3 ELSE 0 END AS r FROM b FULL JOIN a USING (subject, target)) SELECT subject, CASE max(r) WHEN 3 THEN 'affected' WHEN 2 THEN 'possibly_affected' ELSE 'unaffected' END AS verdict FROM r GROUP BY 1""")
def contextual_impact(spark: SparkSession, d: str) -> DataFrame:
    return impact_of(table(spark, d, "lineitem"))


def impact_of(l: DataFrame) -> DataFrame:
    deps = lambda rows, digest: rows.groupBy(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("target")).agg(digest.alias("digest")).withColumn("kind", F.lit("calls")).withColumn("resolution", F.lit("resolved"))
    return C.impact(deps(l.where("l_shipdate < timestamp_ntz'1996-06-01'"), F.min("l_returnflag")), deps(l.where("l_shipdate > timestamp_ntz'1993-01-01'"), F.max("l_returnflag")))
