"""Filters, joins, aggregates, windows, order and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import relational as R
from quillon.plans.registry import query
from quillon.sources.tables import table

# --- filters and projections -------------------------------------------------


@query("f1_projection", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def f1(spark, root):
    return table(spark, root, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@query("f2_predicates", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 200000 AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def f2(spark, root):
    o = table(spark, root, "orders")
    return o.where((F.col("o_orderstatus") == "F") & F.col("o_totalprice").between(100000, 200000) & R.in_list(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"])).select("o_orderkey")


@query("f2_empty_list", "SELECT o_orderkey FROM orders WHERE false")
def f2_empty(spark, root):
    return table(spark, root, "orders").where(R.in_list(F.col("o_orderpriority"), [])).select("o_orderkey")


@query("f3_touching_edges", "SELECT n.k AS node, e.l_orderkey, e.l_linenumber FROM (SELECT p_partkey AS k FROM part WHERE p_size = 7) n JOIN lineitem e ON e.l_partkey = n.k OR e.l_suppkey = n.k")
def f3(spark, root):
    nodes = table(spark, root, "part").where("p_size = 7").select(F.col("p_partkey").alias("node"))
    edges = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return R.touching(edges, nodes, "l_partkey", "l_suppkey", "node").select("node", "l_orderkey", "l_linenumber")


@query("f4_null_safe", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT DISTINCT FROM NULL")
def f4(spark, root):
    d, lab = table(spark, root, "documents").select("doc_id"), table(spark, root, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").where(F.col("quality").eqNullSafe(F.lit(None)))


@query("f5_case_insensitive", "SELECT a.n_nationkey, b.n_nationkey AS other FROM nation a JOIN nation b ON lower(a.n_name) = lower(upper(b.n_name))")
def f5(spark, root):
    n = table(spark, root, "nation").select("n_nationkey", F.lower("n_name").alias("k"))
    m = table(spark, root, "nation").select(F.col("n_nationkey").alias("other"), F.lower(F.upper("n_name")).alias("k"))
    return n.join(m, "k").select("n_nationkey", "other")


@query("f6_like_classifier", "SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%ring%' THEN 'ring' WHEN lower(p_name) LIKE '%widget%' THEN 'widget' ELSE 'other' END AS kind FROM part")
def f6(spark, root):
    name = F.lower("p_name")
    return table(spark, root, "part").select("p_partkey", F.when(name.contains("ring"), "ring").when(name.contains("widget"), "widget").otherwise("other").alias("kind"))


@query("f7_row_value", "SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) > (20, 3)")
def f7(spark, root):
    c = table(spark, root, "conversations")
    return c.where(R.row_greater([F.col("conv_id"), F.col("turn")], [F.lit(20).cast("long"), F.lit(3).cast("long")])).select("conv_id", "turn")


@query("f8_exactly_one", "SELECT doc_id, quality, toxic FROM (SELECT d.doc_id, l.quality, CASE WHEN d.doc_id % 2 = 0 THEN 1 END AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE (quality IS NOT NULL) <> (toxic IS NOT NULL)")
def f8(spark, root):
    d = table(spark, root, "documents").select("doc_id").join(table(spark, root, "labels").select("doc_id", "quality"), "doc_id", "left")
    d = d.withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, 1))
    return d.where(R.exactly_one(F.col("quality"), F.col("toxic")))


@query("f9_contract_issues", """
    SELECT event_id, 'value_negative' AS issue FROM events WHERE value < 0
    UNION ALL SELECT event_id, 'value_large' FROM events WHERE value > 40
    UNION ALL SELECT event_id, 'type_unknown' FROM events WHERE event_type NOT IN ('click', 'purchase', 'error', 'signup')""")
def f9(spark, root):
    e = table(spark, root, "events")
    rules = {"value_negative": F.col("value") < 0, "value_large": F.col("value") > 40, "type_unknown": ~F.col("event_type").isin("click", "purchase", "error", "signup")}
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return e.select("event_id", F.explode(found).alias("issue"))  # one scan for all rules


@query("f10_json_type", "SELECT event_id, json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') AS is_number FROM events")
def f10(spark, root):
    v = F.try_parse_json("props")
    return table(spark, root, "events").select("event_id", F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")).isin("BIGINT", "TINYINT", "INT"), F.lit(False)).alias("is_number"))


@query("f11_scope_filter", "SELECT doc_id FROM documents WHERE lower(lang) NOT IN ('de', 'fr')")
def f11(spark, root):
    return table(spark, root, "documents").where(~R.in_list(F.lower("lang"), ["de", "fr"])).select("doc_id")


@query("f12_suppression", "SELECT event_id, event_type FROM events WHERE NOT (event_type = 'view' AND user_id % 3 = 0) AND NOT (event_type = 'click' AND user_id % 3 = 1)")
def f12(spark, root):
    """Rules that are suppressed in some scopes only."""
    ignored = spark.createDataFrame([("view", 0), ("click", 1)], "event_type string, scope long")
    e = table(spark, root, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("scope"))
    return e.join(ignored, ["event_type", "scope"], "left_anti").select("event_id", "event_type")


# --- joins ------------------------------------------------------------------------


@query("j1_snowflake", "SELECT l_orderkey, l_linenumber, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 45")
def j1(spark, root):
    t = lambda n: table(spark, root, n)
    li = t("lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cust = t("customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    return li.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name")


@query("j2_left_dimensions", "SELECT d.doc_id, l.quality, b.item_id FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def j2(spark, root):
    d = table(spark, root, "documents").select("doc_id")
    b = table(spark, root, "benchmark").select(F.col("item_id"))
    return d.join(table(spark, root, "labels").select("doc_id", "quality"), "doc_id", "left").join(b, d["doc_id"] == b["item_id"], "left").select("doc_id", "quality", "item_id")


@query("j3_role_playing", "SELECT o_orderkey, cn.n_name AS customer_nation, sn.n_name AS supplier_nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON s_suppkey = o_orderkey % 100 JOIN nation sn ON s_nationkey = sn.n_nationkey")
def j3(spark, root):
    t = lambda n: table(spark, root, n)
    cn, sn = t("nation").alias("cn"), t("nation").alias("sn")
    out = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(cn, F.col("c_nationkey") == F.col("cn.n_nationkey"))
    out = out.join(t("supplier"), F.col("s_suppkey") == F.col("o_orderkey") % 100).join(sn, F.col("s_nationkey") == F.col("sn.n_nationkey"))
    return out.select("o_orderkey", F.col("cn.n_name").alias("customer_nation"), F.col("sn.n_name").alias("supplier_nation"))


@query("j4_scalar_lookup", "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region WHERE n_nationkey < 5 AND r_name = 'ASIA'")
def j4(spark, root):
    # Both sides are fixed lookup tables: 25 and 5 rows.
    return table(spark, root, "nation").where("n_nationkey < 5").select("n_nationkey").crossJoin(F.broadcast(table(spark, root, "region").where("r_name = 'ASIA'").select("r_regionkey")))


@query("j5_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j5(spark, root):
    return table(spark, root, "documents").select("doc_id").join(table(spark, root, "labels"), "doc_id", "left_anti")


@query("j6_anti_composite", "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND b.l_linenumber < a.l_linenumber WHERE b.l_orderkey IS NULL AND a.l_linenumber > 1")
def j6(spark, root):
    a, b = table(spark, root, "lineitem").alias("a"), table(spark, root, "lineitem").alias("b")
    cond = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_partkey") == F.col("b.l_partkey")) & (F.col("b.l_linenumber") < F.col("a.l_linenumber"))
    return a.where("l_linenumber > 1").join(b, cond, "left_anti").select("l_orderkey", "l_linenumber")


@query("j7_not_exists", "SELECT o_custkey, o_orderkey FROM orders x WHERE NOT EXISTS (SELECT 1 FROM orders y WHERE y.o_custkey = x.o_custkey AND y.o_totalprice > x.o_totalprice)")
def j7(spark, root):
    table(spark, root, "orders").createOrReplaceTempView("quillon_orders")
    return spark.sql("SELECT o_custkey, o_orderkey FROM quillon_orders x WHERE NOT EXISTS (SELECT 1 FROM quillon_orders y WHERE y.o_custkey = x.o_custkey AND y.o_totalprice > x.o_totalprice)")


@query("j8_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j8(spark, root):
    big = table(spark, root, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, root, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("j9_scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def j9(spark, root):
    p = table(spark, root, "part")
    return p.crossJoin(F.broadcast(p.agg(F.avg("p_retailprice").alias("m")))).where("p_retailprice > m").select("p_partkey")


@query("j10_fallback_match", """
    WITH o AS (SELECT doc_id AS old_id, doc_id AS uid, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0),
    n AS (SELECT doc_id + 100000 AS new_id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS uid, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0),
    m0 AS (SELECT new_id, old_id, 0 AS rule FROM n JOIN o USING (uid)),
    n1 AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY new_id) AS k FROM n WHERE new_id NOT IN (SELECT new_id FROM m0)),
    o1 AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY old_id) AS k FROM o WHERE old_id NOT IN (SELECT old_id FROM m0))
    SELECT * FROM m0 UNION ALL SELECT new_id, old_id, 1 FROM n1 JOIN o1 USING (h, k)""")
def j10(spark, root):
    d = table(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    old = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("old_id"), F.col("doc_id").alias("uid"), "h")
    new = d.where("doc_id % 5 <> 0").select((F.col("doc_id") + 100000).alias("new_id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("uid"), "h")
    return R.fallback_match(new, old, ["uid", "h"], "new_id", "old_id")


@query("j11_name_lookup", """
    WITH k AS (SELECT n_nationkey AS id, lower(n_name) AS key, 0 AS pref FROM nation UNION ALL SELECT n_nationkey, lower(substr(n_name, 1, 3)), 1 FROM nation UNION ALL SELECT n_nationkey, 'n' || n_nationkey, 2 FROM nation),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pref, id) AS rn FROM k)
    SELECT q.key, r.id FROM (SELECT DISTINCT lower(substr(n_name, 1, 3)) AS key FROM nation) q JOIN r ON q.key = r.key AND rn = 1""")
def j11(spark, root):
    from quillon.operators.knowledge import lookup

    n = table(spark, root, "nation")
    maps = [n.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("key")), n.select(F.col("n_nationkey").alias("id"), F.lower(F.substring("n_name", 1, 3)).alias("key")),
            n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"))]
    wanted = n.select(F.lower(F.substring("n_name", 1, 3)).alias("key")).distinct()
    return lookup(wanted, maps)


_CLAIMS = "SELECT event_id AS id, user_id AS subject, event_type AS predicate, cast(json_extract_string(props, '$.k') AS BIGINT) AS val, event_id AS s, event_id + 200 AS e FROM events"


def claims(spark, root):
    e = table(spark, root, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"),
                    F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("val"), F.col("event_id").alias("s"), (F.col("event_id") + 200).alias("e"))


@query("j12_interval_overlap", f"""
    WITH c AS ({_CLAIMS})
    SELECT a.subject, a.predicate, a.id AS "left", b.id AS "right" FROM c a JOIN c b ON a.subject = b.subject AND a.predicate = b.predicate AND a.id < b.id AND a.val <> b.val AND greatest(a.s, b.s) <= least(a.e, b.e)""")
def j12(spark, root):
    return R.overlapping_pairs(claims(spark, root), ["subject", "predicate"], "id", "s", "e", "val")


@query("j14_rule_match", """
    WITH r(rule, pat) AS (VALUES ('a_tion', 'tion tion'), ('b_ment', '(^|[^a-z])ment[^a-z]'), ('c_excl', '!!'))
    SELECT doc_id, rule FROM documents, r WHERE regexp_matches(text, pat)""")
def j14(spark, root):
    from quillon.operators.audit import match_rules

    rules = {"a_tion": "tion tion", "b_ment": "(^|[^a-z])ment[^a-z]", "c_excl": "!!"}
    return match_rules(table(spark, root, "documents").select("doc_id", "text"), rules, "text").select("doc_id", "rule")


@query("j15_positional_zip", "SELECT a.doc_id, a.pos, a.line <> b.line AS changed FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) a JOIN (SELECT doc_id, generate_subscripts(string_split(lower(text), chr(10)), 1) - 1 AS pos, unnest(string_split(lower(text), chr(10))) AS line FROM documents) b USING (doc_id, pos)")
def j15(spark, root):
    d = table(spark, root, "documents")
    zipped = F.arrays_zip(F.split("text", "\n").alias("x"), F.split(F.lower("text"), "\n").alias("y"))
    return d.select("doc_id", F.posexplode(zipped).alias("pos", "z")).select("doc_id", F.col("pos").cast("long").alias("pos"), (F.col("z.x") != F.col("z.y")).alias("changed"))


@query("j16_registry_check", """
    WITH a AS (SELECT row_number() OVER (ORDER BY n_name) AS pos, n_name AS t FROM nation WHERE n_nationkey <> 3),
    b AS (SELECT row_number() OVER (ORDER BY n_name DESC) AS pos, n_name AS t FROM nation)
    SELECT coalesce(a.pos, b.pos) AS pos, CASE WHEN a.t IS NULL THEN 'missing' WHEN b.t IS NULL THEN 'extra' WHEN a.t <> b.t THEN 'title' ELSE 'ok' END AS status FROM a FULL JOIN b ON a.pos = b.pos""")
def j16(spark, root):
    n = table(spark, root, "nation")
    a = n.where("n_nationkey <> 3").select(F.row_number().over(W.orderBy("n_name")).cast("long").alias("pos"), F.col("n_name").alias("a"))  # 25 rows
    b = n.select(F.row_number().over(W.orderBy(F.desc("n_name"))).cast("long").alias("pos"), F.col("n_name").alias("b"))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.col("a") != F.col("b"), "title").otherwise("ok")
    return a.join(b, "pos", "full_outer").select("pos", status.alias("status"))


@query("j18_identity_match", """
    WITH w AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS uid, lower(c_name) AS name FROM customer),
    u AS (SELECT c_custkey + 5000000 AS eid, c_custkey AS uid, lower(c_name) AS name FROM customer WHERE c_custkey % 4 <> 0)
    SELECT w.id, coalesce(a.eid, b.eid) AS eid, CASE WHEN a.eid IS NOT NULL THEN 1.0::DOUBLE WHEN b.eid IS NOT NULL THEN 0.5::DOUBLE END AS confidence FROM w LEFT JOIN u a ON w.uid = a.uid LEFT JOIN u b ON w.name = b.name""")
def j18(spark, root):
    from quillon.operators.knowledge import match_identity

    c = table(spark, root, "customer")
    w = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("uid"), F.lower("c_name").alias("name"))
    u = c.where("c_custkey % 4 <> 0").select((F.col("c_custkey") + 5000000).alias("eid"), F.col("c_custkey").alias("uid"), F.lower("c_name").alias("name"))
    return match_identity(w, u)


@query("j19_reference_join", "SELECT DISTINCT doc_id, s AS ref FROM (SELECT doc_id, unnest([doc_id % 60, doc_id % 7]) AS s FROM documents) LEFT JOIN benchmark ON item_id = s WHERE item_id IS NULL")
def j19(spark, root):
    d = table(spark, root, "documents").select("doc_id", F.explode(F.array(F.col("doc_id") % 60, F.col("doc_id") % 7)).alias("ref")).distinct()
    return d.join(table(spark, root, "benchmark").select(F.col("item_id").alias("ref")), "ref", "left_anti").select("doc_id", "ref")


# --- aggregates ---------------------------------------------------------------------------


@query("a1_grouped_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def a1(spark, root):
    return table(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("a2_distinct_counts", "SELECT n_regionkey, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_regionkey")
def a2(spark, root):
    t = lambda n: table(spark, root, n)
    geo = t("nation").select("n_nationkey", "n_regionkey")
    cust = geo.join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_custkey")
    orders = cust.join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("n_regionkey", "o_orderkey")
    parts = orders.join(t("lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("n_regionkey", "l_partkey")
    # Keys are unique per level, so each level is counted on its own rows; no expand over the widest join.
    one = cust.groupBy("n_regionkey").agg(F.count("c_custkey").alias("customers"))
    two = orders.groupBy("n_regionkey").agg(F.count("o_orderkey").alias("orders"))
    three = parts.distinct().groupBy("n_regionkey").agg(F.count("l_partkey").alias("parts"))
    out = geo.select("n_regionkey").distinct().join(one, "n_regionkey", "left").join(two, "n_regionkey", "left").join(three, "n_regionkey", "left")
    return out.na.fill(0)


@query("a3_having_zero", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 5")
def a3(spark, root):
    n = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, root, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n"]).where("n < 5")


@query("a4_conditional_count", "SELECT count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) AS n FROM labels")
def a4(spark, root):
    return table(spark, root, "labels").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count(F.lit(1)).alias("n"))


@query("a5_frequencies", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a5(spark, root):
    return table(spark, root, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a6_grouping_sets", "SELECT source, lang, CAST(grouping(source, lang) AS BIGINT) AS level, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((source), (source, lang), (lang), ())")
def a6(spark, root):
    d = table(spark, root, "documents")
    out = d.groupingSets([[d["source"]], [d["source"], d["lang"]], [d["lang"]], []], d["source"], d["lang"])
    return out.agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("a7_ratios", "SELECT lang, round(sum(n_chars) / greatest(count(*), 1), 4) AS per_doc, round(1000.0 * count(*) FILTER (WHERE text LIKE '%!!%') / greatest(count(*), 1), 4) AS per_thousand FROM documents GROUP BY lang")
def a7(spark, root):
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return table(spark, root, "documents").groupBy("lang").agg(F.round(F.sum("n_chars") / n, 4).alias("per_doc"), F.round(1000.0 * F.count_if(F.col("text").contains("!!")) / n, 4).alias("per_thousand"))


@query("a8_duplicates", "SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def a8(spark, root):
    return R.duplicates(table(spark, root, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("a9_unique_only", "SELECT any_value(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY sha256(text) HAVING count(*) = 1")
def a9(spark, root):
    return R.unique_only(table(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "h")


@query("a11_nested", "SELECT user_id, CAST(list(event_id ORDER BY event_id) AS VARCHAR) AS ids FROM events GROUP BY user_id")
def a11(spark, root):
    ids = F.array_sort(F.collect_list("event_id"))
    return table(spark, root, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]")).alias("ids"))


@query("a14_conflicting_sets", f"WITH c AS ({_CLAIMS}) SELECT subject, predicate, count(DISTINCT val) AS n FROM c GROUP BY ALL HAVING count(DISTINCT val) > 1")
def a14(spark, root):
    return claims(spark, root).groupBy("subject", "predicate").agg(F.count_distinct("val").alias("n")).where("n > 1")


@query("a15_top_authority", """
    WITH t AS (SELECT o_custkey, o_orderstatus, cast(substr(o_orderpriority, 1, 1) AS INT) AS rank FROM orders),
    m AS (SELECT *, max(rank) OVER (PARTITION BY o_custkey) AS top FROM t)
    SELECT o_custkey, count(DISTINCT o_orderstatus) AS n, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'error' ELSE 'ok' END AS severity FROM m WHERE rank = top GROUP BY o_custkey""")
def a15(spark, root):
    t = table(spark, root, "orders").select("o_custkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"))
    # One aggregate by rank first, then the best rank of each key: no window, little to shuffle.
    by_rank = t.groupBy("o_custkey", "rank").agg(F.collect_set("o_orderstatus").alias("values"))
    best = by_rank.groupBy("o_custkey").agg(F.max_by("values", "rank").alias("values"))
    n = F.size("values").cast("long")
    return best.select("o_custkey", n.alias("n"), F.when(n > 1, "error").otherwise("ok").alias("severity"))


@query("a16_rollup_status", "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'view') THEN 'warnings' ELSE 'passed' END AS status FROM events GROUP BY user_id")
def a16(spark, root):
    worst = F.max(F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 1).otherwise(0))
    return table(spark, root, "events").groupBy("user_id").agg(F.element_at(F.array(F.lit("passed"), F.lit("warnings"), F.lit("failed")), worst + 1).alias("status"))


@query("a18_section_share", "WITH s AS (SELECT source, lang, sum(n_chars) AS c FROM documents GROUP BY ALL), t AS (SELECT source, sum(n_chars) AS a FROM documents GROUP BY source) SELECT source, lang, round(c / a, 6) AS share, c / a < 0.2 AS low FROM s JOIN t USING (source)")
def a18(spark, root):
    s = table(spark, root, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("c"))
    # The parts are already one row a group; their totals come from them.
    t = s.groupBy("source").agg(F.sum("c").alias("a"))
    return s.join(t, "source").select("source", "lang", F.round(F.col("c") / F.col("a"), 6).alias("share"), (F.col("c") / F.col("a") < 0.2).alias("low"))


@query("a19_density_level", "WITH t AS (SELECT doc_id, len(string_split(text, ' ')) AS words, (length(text) - length(replace(text, '!!', ''))) / 2 AS hits FROM documents) SELECT doc_id, CAST(hits AS BIGINT) AS hits, CASE WHEN hits >= greatest(4, ceil(words / 1000.0)) THEN 'high' WHEN hits > 0 THEN 'low' ELSE 'none' END AS level FROM t")
def a19(spark, root):
    hits = ((F.length("text") - F.length(F.replace("text", F.lit("!!"), F.lit("")))) / 2).cast("long")
    d = table(spark, root, "documents").select("doc_id", hits.alias("hits"), F.size(F.split("text", " ")).alias("words"))
    return d.select("doc_id", "hits", F.when(F.col("hits") >= F.greatest(F.lit(4.0), F.ceil(F.col("words") / 1000.0).cast("double")), "high").when(F.col("hits") > 0, "low").otherwise("none").alias("level"))


@query("a20_completeness", "SELECT d.doc_id, CAST(round(100.0 * ((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (lang <> 'en')::INT) / 3) AS BIGINT) AS score FROM documents d LEFT JOIN labels USING (doc_id)")
def a20(spark, root):
    d = table(spark, root, "documents").select("doc_id", "lang").join(table(spark, root, "labels"), "doc_id", "left")
    filled = F.size(F.filter(F.array(F.col("quality").isNotNull(), F.col("toxic").isNotNull(), F.col("lang") != "en"), lambda x: x))
    return d.select("doc_id", F.round(100.0 * filled / 3).cast("long").alias("score"))


# --- windows ------------------------------------------------------------------------------------


@query("w1_at_maximum", "SELECT p_partkey FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def w1(spark, root):
    return R.at_maximum(table(spark, root, "part"), "p_size").select("p_partkey")


@query("w2_at_group_maximum", "SELECT p_partkey, p_brand FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part) WHERE p_size = m")
def w2(spark, root):
    return R.at_maximum(table(spark, root, "part").select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"]).select("p_partkey", "p_brand")


@query("w3_ranked_claims", "SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(cast(json_extract_string(props, '$.k') AS BIGINT), 0) DESC, value DESC) AS INT) AS rank FROM events")
def w3(spark, root):
    k = F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"), F.lit(0))
    w = W.partitionBy("user_id", "event_type").orderBy(F.desc(k), F.desc("value"))
    return table(spark, root, "events").select("event_id", F.dense_rank().over(w).alias("rank"))


@query("w5_first_value_conflict", "SELECT event_id, reference FROM (SELECT event_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS reference FROM events) WHERE event_type <> reference")
def w5(spark, root):
    return R.conflicts_with_first(table(spark, root, "events"), ["user_id"], [F.col("event_id")], "event_type").select("event_id", "reference")


@query("w6_terminal_carry", """
    WITH t AS (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS term FROM events),
    h AS (SELECT event_id, user_id, term, row_number() OVER (PARTITION BY user_id, term ORDER BY event_id) AS rn FROM t WHERE term IS NOT NULL AND event_type = 'purchase')
    SELECT event_id, user_id, term FROM h WHERE rn = 1""")
def w6(spark, root):
    e = table(spark, root, "events")
    t = R.carry_forward(e, ["user_id"], [F.col("event_id")], F.col("event_type") == "error", F.col("event_id"), "term")
    return R.top_per_key(t.where("term IS NOT NULL AND event_type = 'purchase'"), ["user_id", "term"], [F.col("event_id")]).select("event_id", "user_id", "term")


@query("w7_milestone_inversion", """
    WITH m AS (SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 END AS idx FROM events),
    p AS (SELECT *, lag(idx) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM m WHERE idx IS NOT NULL)
    SELECT event_id, user_id, idx, prev FROM p WHERE idx < prev""")
def w7(spark, root):
    idx = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2)
    m = table(spark, root, "events").select("event_id", "user_id", idx.alias("idx")).where("idx IS NOT NULL")
    return m.withColumn("prev", F.lag("idx").over(W.partitionBy("user_id").orderBy("event_id"))).where("idx < prev")


@query("w8_runs", """
    WITH t AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
    SELECT user_id, event_type, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM t GROUP BY user_id, event_type, g HAVING count(*) >= 3""")
def w8(spark, root):
    return R.runs(table(spark, root, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id", "event_type", 3)


@query("w9_section_propagation", "SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations")
def w9(spark, root):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table(spark, root, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("section"))


@query("w11_previous_context", "SELECT conv_id, turn, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def w11(spark, root):
    return table(spark, root, "conversations").select("conv_id", "turn", F.lag(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("before"))


@query("w12_level_jump", "SELECT event_id FROM (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) WHERE d > 30")
def w12(spark, root):
    d = F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy("event_id"))
    return table(spark, root, "events").select("event_id", d.alias("d")).where("d > 30").select("event_id")


@query("w13_segment_ends", "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS \"end\" FROM events")
def w13(spark, root):
    return table(spark, root, "events").select("event_id", (F.lead("event_id").over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("end"))


@query("w14_running_offsets", "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text) AS BIGINT) AS offset_ FROM conversations")
def w14(spark, root):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table(spark, root, "conversations").select("conv_id", "turn", (F.sum(F.length("text")).over(w) - F.length("text")).cast("long").alias("offset_"))


@query("w17_cap_per_key", "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rn, embedding[1] AS s FROM embeddings) WHERE rn <= 2 ORDER BY s DESC, vec_id LIMIT 8")
def w17(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).alias("s"))
    return R.top_per_key(e, ["label"], [F.desc("s"), F.col("vec_id")], 2).orderBy(F.desc("s"), "vec_id").limit(8).select("vec_id", "label")


@query("w18_disambiguation", "SELECT p_partkey, CASE WHEN rn = 1 THEN s ELSE s || '-' || rn END AS slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS s, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)")
def w18(spark, root):
    p = table(spark, root, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("s"))
    rn = F.row_number().over(W.partitionBy("s").orderBy("p_partkey"))
    return p.withColumn("rn", rn).select("p_partkey", F.when(F.col("rn") == 1, F.col("s")).otherwise(F.concat_ws("-", "s", F.col("rn").cast("string"))).alias("slug"))


# --- order and sets --------------------------------------------------------------------------------


@query("o1_multi_key_sort", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def o1(spark, root):
    return table(spark, root, "part").select("p_partkey", "p_brand", "p_size").orderBy("p_brand", F.desc("p_size"), "p_partkey")


@query("o2_sort_by_expression", "SELECT n_name FROM nation ORDER BY CASE WHEN n_regionkey = 2 THEN 0 ELSE 1 END, n_name LIMIT 7")
def o2(spark, root):
    return table(spark, root, "nation").orderBy(F.when(F.col("n_regionkey") == 2, 0).otherwise(1), "n_name").limit(7).select("n_name")


@query("o3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o3(spark, root):
    return table(spark, root, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("o6_latest_per_group", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def o6(spark, root):
    return table(spark, root, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))


@query("o7_keep_newest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 3")
def o7(spark, root):
    return R.top_per_key(table(spark, root, "events").select("user_id", "event_id"), ["user_id"], [F.desc("event_id")], 3)


@query("o8_truncated_report", "SELECT user_id, count(*) AS total, greatest(count(*) - 5, 0) AS truncated FROM events GROUP BY user_id")
def o8(spark, root):
    n = F.count(F.lit(1))
    return table(spark, root, "events").groupBy("user_id").agg(n.alias("total"), F.greatest(n - 5, F.lit(0)).alias("truncated"))


@query("u1_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def u1(spark, root):
    return table(spark, root, "nation").select(F.col("n_name").alias("name")).unionAll(table(spark, root, "region").select("r_name"))


@query("u3_distinct", "SELECT DISTINCT lang, source FROM documents")
def u3(spark, root):
    return table(spark, root, "documents").select("lang", "source").distinct()


@query("u4_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u4(spark, root):
    return table(spark, root, "documents").select("doc_id").subtract(table(spark, root, "labels").select("doc_id"))


@query("u5_last_write_wins", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def u5(spark, root):
    return table(spark, root, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))


# --- sinks, incremental maintenance ---------------------------------------------------------------------

_SNAP = "WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0)"


def snapshots(spark, root):
    d = table(spark, root, "documents")
    old = d.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = d.where("doc_id % 13 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("h"))
    return old, new


@query("k1_upsert", _SNAP + " SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def k1(spark, root):
    return R.upsert(*snapshots(spark, root), ["doc_id"])


@query("k1_insert_ignore", _SNAP + " SELECT * FROM o UNION ALL SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)")
def k1_ignore(spark, root):
    return R.insert_ignore(*snapshots(spark, root), ["doc_id"])


@query("k2_replace_source", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id + 1000000, source FROM documents WHERE source IN ('src1', 'src2')")
def k2(spark, root):
    d = table(spark, root, "documents").select("doc_id", "source")
    fresh = d.where(F.col("source").isin("src1", "src2")).withColumn("doc_id", F.col("doc_id") + 1000000)
    return R.replace_source(d, fresh, "source")


@query("i2_snapshot_diff", _SNAP + " SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'inserted' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS status FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def i2(spark, root):
    return R.snapshot_diff(*snapshots(spark, root), "doc_id", "h")


@query("i1_fast_path", _SNAP + " SELECT o.h = n.h AS same, count(*) AS docs FROM o JOIN n USING (doc_id) GROUP BY 1")
def i1(spark, root):
    old, new = snapshots(spark, root)
    return old.join(new.withColumnRenamed("h", "h2"), "doc_id").groupBy((F.col("h") == F.col("h2")).alias("same")).agg(F.count(F.lit(1)).alias("docs"))


@query("i3_revision_chain", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS parent FROM events")
def i3(spark, root):
    return table(spark, root, "events").select("event_id", F.lag("event_id").over(W.partitionBy("user_id", "event_type").orderBy("event_id")).alias("parent"))


@query("i4_tombstones", _SNAP + " SELECT doc_id, h FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def i4(spark, root):
    old, new = snapshots(spark, root)
    return old.join(new, "doc_id", "left_anti")


@query("i5_derivation_status", _SNAP + " SELECT n.doc_id, CASE WHEN o.h IS NULL THEN 'pending' WHEN o.h = n.h THEN 'fresh' ELSE 'stale' END AS status FROM n LEFT JOIN o USING (doc_id)")
def i5(spark, root):
    status = F.when(F.col("status") == "inserted", "pending").when(F.col("status") == "unchanged", "fresh").otherwise("stale")
    return R.snapshot_diff(*snapshots(spark, root), "doc_id", "h").where("status <> 'deleted'").select("doc_id", status.alias("status"))


@query("i9_entity_merge", "SELECT DISTINCT s, t FROM (SELECT CASE WHEN l_partkey % 10 = 3 THEN l_partkey - 1 ELSE l_partkey END AS s, CASE WHEN l_suppkey % 10 = 3 THEN l_suppkey - 1 ELSE l_suppkey END AS t FROM lineitem) WHERE s <> t")
def i9(spark, root):
    from quillon.operators.knowledge import repoint

    e = table(spark, root, "lineitem").select(F.col("l_partkey").alias("s"), F.col("l_suppkey").alias("t"))
    both = e.select(F.col("s").alias("k")).union(e.select("t")).distinct()
    merged = both.where("k % 10 = 3").select(F.col("k").alias("source"), (F.col("k") - 1).alias("target"))
    return repoint(e, merged, ["s", "t"])


@query("i10_redirects", "WITH RECURSIVE e AS (SELECT p_partkey AS s, p_partkey // 3 AS t FROM part WHERE p_partkey > 0), c AS (SELECT s, t FROM e UNION ALL SELECT c.s, e.t FROM c JOIN e ON c.t = e.s) SELECT s, min(t) AS t FROM c GROUP BY s")
def i10(spark, root):
    e = table(spark, root, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("s"), F.floor(F.col("p_partkey") / 3).alias("t"))
    return R.resolve_redirects(e, "s", "t")
