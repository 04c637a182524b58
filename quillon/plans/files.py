"""Sources, sinks and SQL functions over data that comes from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import sql
from quillon.operators import search as S
from quillon.operators.index import TextIndex
from quillon.operators.vector_index import VectorIndex
from quillon.plans.registry import ORACLES, query
from quillon.session import scratch, tasks_for
from quillon.sources import files
from quillon.sources.tables import table

#: Lines of the files that a task writes.
LINES = 10_000


@query("s3_event_log", "SELECT user_id, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_id % 3 <> 0 GROUP BY ALL")
def s3(spark, root):
    """Events written as JSON lines in two goes and read with a schema; the order is a column's, not the files'."""
    e, path = table(spark, root, "events").select("event_id", "user_id", "event_type"), scratch(spark, "events")
    for k in (1, 2):
        e.where(F.col("event_id") % 3 == k).write.mode("append").json(path)
    return files.events(spark, path, "event_id long, user_id long, event_type string").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("s6_probe", """
    WITH t AS (SELECT o_custkey AS k, string_agg('order ' || o_orderkey || chr(10), '' ORDER BY o_orderkey) AS t FROM orders WHERE o_custkey % 10 = 3 GROUP BY 1)
    SELECT k, sha256(t) AS sha256, length(t) - length(replace(t, chr(10), '')) AS n_lines, length(t) AS n_bytes FROM t""")
def s6(spark, root):
    """A file a customer with a line an order: digest, lines and bytes of each."""
    o, path = table(spark, root, "orders").where("o_custkey % 10 = 3"), scratch(spark, "probe")
    lines = o.select(F.col("o_custkey").alias("k"), "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("value"))
    # A folder a task holds those of its customers: the commit and the listing handle folders of tasks, not of customers.
    dealt = lines.repartition(tasks_for(spark, lines.count(), LINES), "k").withColumn("task", F.spark_partition_id())
    dealt.sortWithinPartitions("task", "k", "o_orderkey").select("task", "k", "value").write.options(**files.PLAIN).partitionBy("task", "k").text(path)
    found = files.probe(spark, f"{path}/task=*", deep=True)
    return found.select(F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("long").alias("k"), "sha256", F.col("n_lines").cast("long").alias("n_lines"), "n_bytes")


@query("k4_atomic_swap", "SELECT c_mktsegment, count(*) AS n, 1 AS backups FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1")
def k4(spark, root):
    """A dataset swapped twice, backed up before each further swap, pruned to one backup, and restored from it."""
    c, path = table(spark, root, "customer").select("c_custkey", "c_mktsegment"), scratch(spark, "swap")
    files.write_atomic(c.where("c_custkey % 2 = 1"), path)
    files.backup(spark, path)
    files.write_atomic(c.where("c_custkey % 2 = 0"), path)
    saved = files.backup(spark, path)
    files.write_atomic(c, path)
    files.prune(spark, path, 1)
    files.restore(spark, saved, path)
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("backups", F.lit(len(files.backups(spark, path))))


@query("k3_json_report", "SELECT o_orderpriority AS severity, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def k3(spark, root):
    path = scratch(spark, "report")
    files.write_report(table(spark, root, "orders").where("o_totalprice > 100000").select("o_orderkey", F.col("o_orderpriority").alias("severity")), path)
    return spark.read.schema("o_orderkey long, severity string").json(path).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("v6_sql_functions", """
    SELECT e.vec_id, round(1 - list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) + 1 AS distance
    FROM embeddings e, embeddings q WHERE q.vec_id = 3 AND e.label = q.label""")
def v6(spark, root):
    sql.register(spark)
    table(spark, root, "embeddings").createOrReplaceTempView("v6_vectors")
    return spark.sql("SELECT e.vec_id, round(vector_distance(CAST(e.embedding AS ARRAY<DOUBLE>), CAST(q.embedding AS ARRAY<DOUBLE>)), 6) + 1 AS distance FROM v6_vectors e JOIN v6_vectors q ON e.label = q.label WHERE q.vec_id = 3")


@query("v6_table_function", "SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS different FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-zÀ-úà-ÿ]+') AS w FROM documents) WHERE len(w) > 0")
def v6_table(spark, root):
    sql.register_more(spark)
    table(spark, root, "documents").createOrReplaceTempView("v6_documents")
    return spark.sql("SELECT doc_id, count(*) AS words, count(DISTINCT word) AS different FROM v6_documents, LATERAL word_table(text) GROUP BY doc_id")


@query("v6_aggregate", ORACLES["a13_multiset_hash"])
def v6_aggregate(spark, root):
    sql.register_more(spark)
    table(spark, root, "documents").createOrReplaceTempView("v6_documents")
    # Dealt as digests: a Python aggregate's arguments are computed after the shuffle, which would carry the texts.
    return spark.sql("SELECT lang, bag_hash(digest) AS h FROM (SELECT /*+ REPARTITION(lang) */ lang, sha2(text, 256) AS digest FROM v6_documents) GROUP BY lang")


@query("q4_indexed", ORACLES["q4_hybrid"])
def q4_indexed(spark, root):
    """The hybrid search with candidates from both indexes."""
    docs = table(spark, root, "documents").select("doc_id", "text", "source")
    vectors = table(spark, root, "embeddings")
    words = TextIndex.create(spark, scratch(spark, "index"), docs, tokens="letters")
    near = VectorIndex.create(spark, scratch(spark, "vectors"), vectors)
    q = [float(x) for x in vectors.where("vec_id = 7").select("embedding").first()[0]]
    found = S.hybrid(docs, vectors, ["tion", "ment"], q, "source", 8, 2, words, near)
    return found.withColumn("distance", F.round(F.col("distance") + 1, 6))
