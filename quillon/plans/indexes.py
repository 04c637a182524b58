"""Indexes that outlive a query, over the driver's tables; each query builds its own in the shared folder."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import hashing as H
from quillon.operators import sync as knowledge_sync
from quillon.operators.diff import apply, hunks
from quillon.operators.index import TextIndex
from quillon.operators.merkle import Level, MerkleTree
from quillon.operators.vector_index import VectorIndex
from quillon.plans.registry import ORACLES, query
from quillon.session import scratch
from quillon.sources import sqlite
from quillon.sources.tables import table
from quillon.streaming.proposals import log_stream, replay_timed


def _bm25(docs: str, terms: tuple[str, ...], k: int) -> str:
    """The k best of ``docs`` (doc_id, text) in SQL."""
    return f"""
    WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM ({docs})),
    dl AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM dl),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN ({", ".join(f"'{t}'" for t in terms)}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score
    FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}"""


@query("v2_index_search", ORACLES["q2_lexical"])
def v2_search(spark, root):
    index = TextIndex.create(spark, scratch(spark, "index"), table(spark, root, "documents"), tokens="letters")
    return index.search(["tion", "ment", "ung"], 20).select(F.col("doc").alias("doc_id"), "score")


_CHANGED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' ung tion' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0"


@query("v2_index_changes", _bm25(_CHANGED, ("tion", "ung"), 30))
def v2_changes(spark, root):
    """Half of the documents first, then the others and new texts for a third, then a fifth deleted."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    index = TextIndex.create(spark, scratch(spark, "index"), docs.where("doc_id % 2 = 0"), tokens="letters")
    changed = docs.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" ung tion")))
    index.add(docs.where("doc_id % 2 <> 0 and doc_id % 3 <> 0").unionByName(changed))
    index.delete(docs.where("doc_id % 5 = 0"))
    return index.search(["tion", "ung"], 30).select(F.col("doc").alias("doc_id"), "score")


@query("v2_index_phrase", """
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)
    SELECT doc_id, count(*)::INT AS n FROM p WHERE w[i] = 'in' AND w[i + 1] = 'the' GROUP BY doc_id""")
def v2_phrase(spark, root):
    index = TextIndex.create(spark, scratch(spark, "index"), table(spark, root, "documents"), tokens="letters")
    return index.matching("in the", phrase=True).select(F.col("doc").alias("doc_id"), "n")


@query("s4_sqlite", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey > 20 AND o_orderkey IS NOT NULL""")
def s4_sqlite(spark, root):
    """Orders written as SQLite databases, a task each, and read back in ranges with columns and filters handed down."""
    path = scratch(spark, "sqlite")
    sqlite.register(spark)
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    orders.repartition(4, "o_custkey").write.format("sqlite").option("table", "orders").mode("append").save(path)
    back = sqlite.sqlite_table(spark, path, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    return back.where("o_orderstatus IN ('F', 'O') AND o_custkey > 20 AND o_orderkey IS NOT NULL")


@query("s5_sqlite_works", "SELECT c_nationkey, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_nationkey) = 1")
def s5_works(spark, root):
    """One database a task, joined to one table that knows the database of each row: no database holds rows of a nation that another one has."""
    path = scratch(spark, "works")
    sqlite.register(spark)
    customers = table(spark, root, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_name")
    customers.repartition(5, "c_nationkey").write.format("sqlite").option("table", "customer").mode("append").save(path)
    rows = sqlite.sqlite_table(spark, path, "customer", ["c_custkey", "c_nationkey"], origin="work")
    by = rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"), F.count_distinct("work").alias("works"))
    return by.where("works = 1").select(F.col("c_nationkey").cast("int").alias("c_nationkey"), "n", "keys")


@query("v1_vector_index", ORACLES["q3_nearest"])
def v1_vectors(spark, root):
    """Exact: the nearest cells, then those that the bound doesn't rule out."""
    vectors = table(spark, root, "embeddings")
    index = VectorIndex.create(spark, scratch(spark, "vectors"), vectors)
    q = [float(x) for x in vectors.where("vec_id = 7").select("embedding").first()[0]]
    return index.search(q, 20, exact=True).select(F.col("id").alias("vec_id"), F.round(F.col("distance") + 1, 6).alias("distance"))


_LEFT = "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN list_transform(embedding, lambda c: -c) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id = 9"


@query("v1_vector_changes", ORACLES["q3_nearest"].replace("FROM embeddings e, embeddings q", f"FROM ({_LEFT}) e, embeddings q").replace("LIMIT 20", "LIMIT 25"))
def v1_changes(spark, root):
    """Half of the vectors first, then the others and opposite vectors for a quarter, then a third deleted but one."""
    vectors = table(spark, root, "embeddings").select("vec_id", "embedding")
    index = VectorIndex.create(spark, scratch(spark, "vectors"), vectors.where("vec_id % 2 = 0"))
    opposite = vectors.where("vec_id % 4 = 0").withColumn("embedding", F.transform("embedding", lambda c: -c))
    index.add(vectors.where("vec_id % 2 <> 0").unionByName(opposite))
    index.delete(vectors.where("vec_id % 3 = 0 AND vec_id <> 9"))
    q = [float(x) for x in vectors.where("vec_id = 7").select("embedding").first()[0]]
    return index.search(q, 25, exact=True).select(F.col("id").alias("vec_id"), F.round(F.col("distance") + 1, 6).alias("distance"))


@query("i11_sync", """
    WITH e AS (SELECT 'c' || c_custkey AS uid, c_name AS name, c_nationkey AS n FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, s_nationkey FROM supplier),
    k AS (SELECT 'c' || o_custkey AS uid, count(*) AS claims, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 1 END)::BIGINT AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 <> 0 OR o_orderkey % 3 = 0 GROUP BY 1),
    a AS (SELECT uid, count(*) AS aliases FROM (SELECT uid, 'of ' || n_name AS alias FROM e JOIN nation ON n = n_nationkey WHERE n % 5 <> 0 OR uid LIKE 's%' UNION ALL SELECT uid, uid || ' renamed' FROM e WHERE n % 5 = 0 AND uid LIKE 'c%') GROUP BY uid)
    SELECT uid, name, CASE WHEN uid LIKE 'c%' THEN 'character' ELSE 'organization' END AS type, coalesce(aliases, 0) AS aliases, coalesce(claims, 0) AS claims, coalesce(total, 0)::BIGINT AS total
    FROM e LEFT JOIN k USING (uid) LEFT JOIN a USING (uid)""")
def i11_sync(spark, root):
    """One knowledge file a nation with its customers, suppliers and orders; then every fifth nation's anew, with other aliases and a third of its claims."""
    nation = table(spark, root, "nation").select(F.col("n_nationkey").alias("n"), "n_name")
    both = table(spark, root, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("uid"), F.col("c_name").alias("name"), F.lit("character").alias("type"), F.col("c_nationkey").alias("n"))
    both = both.unionByName(table(spark, root, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("uid"), F.col("s_name").alias("name"), F.lit("organization").alias("type"), F.col("s_nationkey").alias("n")))
    ordered = table(spark, root, "orders").join(table(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n")), "o_custkey")
    key = F.col("o_orderkey")
    values = F.struct(F.col("c_name").alias("subject"), F.when(key % 2 == 0, "ordered").otherwise("said").alias("predicate"), F.lit("s1").alias("scene_uid"), F.when(key % 2 == 0, F.to_json(F.struct(key.alias("x")))).otherwise('{"x":"text"}').alias("x"), key.alias("key"))

    def files(second: bool):
        # Objects are put together as text, so that a value may be a number here and a text there. A file's lines follow each other; no nation's text is held whole.
        own = F.concat(F.lit("of "), "n_name")
        alias = F.when(F.col("type") == "character", F.concat("uid", F.lit(" renamed"))).otherwise(own) if second else own
        e = both.join(F.broadcast(nation), "n").select("n", F.lit(1).alias("part"), F.col("uid").alias("key"), F.to_json(F.struct("uid", "name", "type", F.array(alias).alias("aliases"))).alias("text"))
        claim = F.concat(F.lit('{"subject":"'), F.col("x.subject"), F.lit('","predicate":"'), F.col("x.predicate"), F.lit('","scene_uid":"s1","value":'), F.regexp_extract("x.x", r"^\{.x.:(.*)\}$", 1), F.lit("}"))
        c = ordered.select("n", values.alias("x"))
        c = (c.where("x.key % 3 = 0") if second else c).select("n", F.lit(3).alias("part"), F.col("x.key").cast("string").alias("key"), claim.alias("text"))
        frame = [(0, '{"schema_version":1,"predicates":[{"code":"ordered","value_kind":"number"}],"entities":['), (2, '],"claims":['), (4, "]}")]
        frame = both.select("n").distinct().select("n", F.inline(F.array(*[F.struct(F.lit(k).alias("part"), F.lit("").alias("key"), F.lit(t).alias("text")) for k, t in frame])))
        lines = e.unionByName(c).unionByName(frame).where("n % 5 = 0" if second else "true").withColumn("name", F.format_string("nation-%02d", "n"))
        comma = F.when(F.lag("part").over(Window.partitionBy("name").orderBy("part", "key")) == F.col("part"), ",").otherwise("")
        return lines.withColumn("text", F.concat(comma, "text")).sortWithinPartitions("name", "part", "key").select("name", "text")

    path = scratch(spark, "files")
    files(False).write.partitionBy("name").text(f"{path}/first")
    files(True).write.partitionBy("name").text(f"{path}/second")
    store = knowledge_sync.create(spark, scratch(spark, "knowledge"))
    scenes = spark.createDataFrame([("s1", "", True)], "scene string, content string, active boolean")
    for part in ("first", "second"):
        found = knowledge_sync.items(spark, f"{path}/{part}/name=*/part-*", F.regexp_extract("path", "/name=([^/]+)/", 1))
        knowledge_sync.sync(store, found, scenes, "work", extract_mentions=False)
    claims = store.read("claims").groupBy(F.col("subject").alias("uid")).agg(F.count(F.lit(1)).alias("claims"), F.sum(F.coalesce(F.col("value").try_cast("long"), F.lit(1))).alias("total"))
    aliases = store.read("aliases").groupBy("uid").agg(F.count(F.lit(1)).alias("aliases"))
    out = store.read("entities").join(claims, "uid", "left").join(aliases, "uid", "left")
    return out.select("uid", "name", "type", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("aliases", "claims", "total")])


_EDITED = "SELECT doc_id, source, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 60 = 7 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 77 <> 3 AND lang <> 'es'"


@query("i6_incremental", ORACLES["i6_merkle"].replace("FROM documents", f"FROM ({_EDITED})").replace("ORDER BY lang)", "ORDER BY lang NULLS FIRST)"))
def i6_incremental(spark, root):
    """Roots after an edit: some texts are longer, some documents have lost their language, some are gone, and all of one language; only their paths are hashed again."""
    d = table(spark, root, "documents").select("doc_id", "source", "lang", "text")
    leaf = lambda df: df.select("source", "lang", "doc_id", H.node_hash("doc", F.col("lang"), F.col("text")).alias("digest"))
    levels = [Level("edition", ["source", "lang"], "doc_id"), Level("work", ["source"], "lang")]
    tree = MerkleTree.create(spark, scratch(spark, "merkle"), leaf(d), levels)
    gone = d.where("doc_id % 77 = 3 OR lang = 'es'")
    left = d.where("doc_id % 77 <> 3 AND lang <> 'es' AND (doc_id % 50 = 0 OR doc_id % 60 = 7)")
    new = left.withColumns({"lang": F.when(F.col("doc_id") % 50 != 0, F.col("lang")), "text": F.when(F.col("doc_id") % 60 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))})
    moved = left.where("doc_id % 50 = 0")
    tree.update(leaf(new), gone.unionByName(moved))
    return tree.roots().withColumnRenamed("digest", "root")


@query("c15_hunks", """
    SELECT doc_id, sha256(t) AS sha, t <> text AS changed FROM (SELECT doc_id, text,
      regexp_replace(replace(CASE WHEN doc_id % 3 = 0 THEN 'first line' || chr(10) || text WHEN doc_id % 3 = 1 THEN text || chr(10) || 'last line' ELSE text END, ' the ', CASE WHEN doc_id % 4 = 0 THEN chr(10) ELSE ' the ' END), chr(10) || '[a-d][^' || chr(10) || ']*', '', 'g') AS t FROM documents)""")
def c15_hunks(spark, root):
    """Hunks from each text to an edited one (lines added, split and removed), carried out: the edited text must come back."""
    d = table(spark, root, "documents").select("doc_id", "text")
    n = F.lit("\n")
    edited = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("first line\n"), "text")).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\nlast line"))).otherwise(F.col("text"))
    edited = F.when(F.col("doc_id") % 4 == 0, F.replace(edited, F.lit(" the "), n)).otherwise(edited)
    both = d.withColumn("after", F.regexp_replace(edited, "\n[a-d][^\n]*", ""))
    found = hunks(both, "doc_id", "text", "after")
    out = apply(both, found, "doc_id", "text", "again")
    return out.join(found.select("doc_id").distinct().withColumn("changed", F.lit(True)), "doc_id", "left").select("doc_id", F.sha2("again", 256).alias("sha"), F.coalesce("changed", F.lit(False)).alias("changed"))


@query("g1_timed", """
    WITH o AS (SELECT o_custkey AS proposal, o_orderdate::DATE AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS k FROM orders),
    p AS (SELECT proposal, min(d) FILTER (WHERE k = 1) AS a, min(d) FILTER (WHERE k = 2) AS b, count(*) FILTER (WHERE k = 3) AS again FROM o WHERE k <= 3 GROUP BY proposal),
    x AS (SELECT *, b IS NOT NULL AND b - a < 100 AS decided FROM p)
    SELECT proposal, 'applied' AS outcome, 1 + decided::INT AS n FROM x UNION ALL SELECT proposal, 'expired', 1 FROM x WHERE NOT decided
    UNION ALL SELECT proposal, 'illegal', 1 FROM x WHERE b IS NOT NULL AND NOT decided UNION ALL SELECT proposal, 'repeated', 1 FROM x WHERE again > 0""")
def g1_timed(spark, root):
    """A log of proposals streamed with event time: a customer's first order suggests, the second one decides if it comes within 100 days, the third repeats the second's uid."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate"), "o_orderkey"))
    o = table(spark, root, "orders").select("o_custkey", F.unix_date(F.to_date("o_orderdate")).alias("day"), k.alias("k")).where("k <= 3")
    second = F.max(F.when(F.col("k") == 2, F.col("day"))).over(Window.partitionBy("o_custkey"))
    day = F.when(F.col("k") == 3, second).otherwise(F.col("day"))
    log = o.select(F.format_string("%d-%d", "o_custkey", F.least("k", F.lit(2))).alias("event_uid"), F.col("o_custkey").alias("proposal_uid"), F.when(F.col("k") == 1, "suggested").otherwise("approved").alias("to_status"), F.timestamp_seconds(day * F.lit(86400).cast("long")).alias("created_at"))
    path, out, state = scratch(spark, "log"), scratch(spark, "outcomes"), scratch(spark, "state")
    log.write.json(path)
    # The last event only moves the watermark beyond all others.
    end = log.agg(F.max("created_at").alias("at")).select(F.lit("end").alias("event_uid"), F.lit(-1).cast("long").alias("proposal_uid"), F.lit("suggested").alias("to_status"), (F.col("at") + F.expr("INTERVAL 20000 DAYS")).alias("created_at"))
    end.write.mode("append").json(path)
    stream = replay_timed(log_stream(spark, path), 100 * 86_400_000, "10000 days")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("proposal", "outcome").agg(F.count(F.lit(1)).cast("int").alias("n"))
