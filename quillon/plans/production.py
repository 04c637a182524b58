"""Further transforms: replacement, diffs, plans, covers, knowledge contracts, readability findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import numeric as N
from quillon.functions import text as T
from quillon.operators import assets as X
from quillon.operators import audit as A
from quillon.operators import cover
from quillon.operators import knowledge as K
from quillon.operators import relational as R
from quillon.operators import search as S
from quillon.plans.registry import query
from quillon.plans.text import _FL, reading
from quillon.session import tasks_for
from quillon.sources.tables import table


@query("c13_title_replace", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(upper(left(p_name, 1)) || substr(p_name, 2), '\\bRed\\b', 'Crimson', 'g') ELSE regexp_replace(p_name, '\\bred\\b', 'crimson', 'g') END AS name FROM part")
def c13(spark, root):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring(F.col("p_name"), F.lit(2), F.length("p_name")))).otherwise(F.col("p_name"))
    return table(spark, root, "part").select("p_partkey", T.replace_word(name, "red", "crimson").alias("name"))


@query("c15_diff")
def c15(spark, root):
    from quillon.functions.python import unified_diff

    t = table(spark, root, "conversations")
    return t.select("conv_id", "turn", unified_diff("text", F.replace("text", F.lit("the"), F.lit("a"))).alias("diff"))


@query("c18_index_tokens", "SELECT doc_id, len(regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\pL\\pN]+')) AS n FROM documents")
def c18(spark, root):
    return table(spark, root, "documents").select("doc_id", F.size(T.index_tokens(F.col("text"))).cast("long").alias("n"))


@query("j17_late_materialisation", "SELECT e.vec_id, d.lang FROM (SELECT vec_id FROM embeddings ORDER BY embedding[1] DESC, vec_id LIMIT 30) e JOIN documents d ON d.doc_id = e.vec_id")
def j17(spark, root):
    top = table(spark, root, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).alias("s")).orderBy(F.desc("s"), "vec_id").limit(30)
    d = table(spark, root, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    return d.join(F.broadcast(top), "vec_id").select("vec_id", "lang")  # at most 30 rows


@query("w4_ranks", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 40")
def w4(spark, root):
    top = table(spark, root, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)
    return S.rank(top, [F.desc("o_totalprice"), F.col("o_orderkey")], "rank").select("o_orderkey", "rank")


@query("w19_free_ordinals", """
    WITH t AS (SELECT user_id, event_id, event_id % 5 AS o FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, o ORDER BY event_id) > 1 AS late, max(o) OVER (PARTITION BY user_id) AS top FROM t)
    SELECT user_id, event_id, CASE WHEN late THEN top + sum(late::INT) OVER (PARTITION BY user_id ORDER BY o, event_id ROWS UNBOUNDED PRECEDING) ELSE o END::BIGINT AS o FROM r""")
def w19(spark, root):
    e = table(spark, root, "events").select("user_id", "event_id", (F.col("event_id") % 5).alias("o"))
    return K.next_free_ordinals(e, ["user_id"], "o", "event_id")


@query("y5_join_array", "SELECT vec_id, array_to_string([vec_id, label, len(embedding)], ' ') AS joined FROM embeddings")
def y5(spark, root):
    parts = F.array(F.col("vec_id"), F.col("label").cast("long"), F.size("embedding").cast("long"))
    return table(spark, root, "embeddings").select("vec_id", F.array_join(parts.cast("array<string>"), " ").alias("joined"))


@query("r15_illustration_plan", """
    WITH p AS (SELECT conv_id AS book, turn AS chapter, (length(text) // 200)::BIGINT AS pages, 2 AS scenes, role AS title FROM conversations),
    q AS (SELECT *, sum(pages) OVER (PARTITION BY book ORDER BY chapter) AS last, count(*) OVER (PARTITION BY book, lower(title)) AS n FROM p)
    SELECT book, chapter, unnest(list_filter([CASE WHEN pages <= 0 THEN 'no_pages' END, CASE WHEN pages > 0 AND NOT round(scenes / greatest(pages, 1), 4) BETWEEN 0.3 AND 1.0 THEN 'density' END, CASE WHEN n > 1 THEN 'duplicate_title' END], lambda x : x IS NOT NULL)) AS issue FROM q""")
def r15(spark, root):
    p = table(spark, root, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("chapter"), F.floor(F.length("text") / 200).alias("pages"), F.lit(2).alias("scenes"), F.col("role").alias("title"))
    return X.plan_issues(X.plan_pages(p), 0.3, 1.0)


@query("r15_page_geometry", "SELECT conv_id AS book, turn AS chapter, CAST(sum(length(text) // 200) OVER w - length(text) // 200 + 1 AS BIGINT) AS \"first\", CAST(sum(length(text) // 200) OVER w AS BIGINT) AS \"last\" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def r15_pages(spark, root):
    p = table(spark, root, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("chapter"), F.floor(F.length("text") / 200).alias("pages"), F.lit(2).alias("scenes"))
    return X.plan_pages(p).select("book", "chapter", "first", "last")


@query("r15_plan_review", """
    WITH t AS (SELECT conv_id AS book, turn, coalesce(length(text), 0) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS pos, 2 + turn % 4 AS n FROM conversations),
    c AS (SELECT *, sum(2 * n) OVER (PARTITION BY book ORDER BY pos) + 2 - CASE WHEN turn % 6 = 5 THEN 1 ELSE 0 END AS last FROM t), s AS (SELECT *, coalesce(lag(last) OVER (PARTITION BY book ORDER BY pos), 2) + 1 AS start FROM c),
    g AS (SELECT *, start + 2 * n - 1 AS fin, CASE WHEN turn % 7 = 3 THEN 1 ELSE 0 END AS shift FROM s), x AS (SELECT *, start + shift AS first FROM g),
    k AS (SELECT x.*, unnest(range(1, n + 1)) AS scene FROM x)
    SELECT book, pos AS chapter, unnest(list_filter([CASE WHEN turn % 5 = 4 THEN 'chapter_mismatch' END, CASE WHEN first <> start OR last <> fin THEN 'page_geometry' END, CASE WHEN last <> fin THEN 'reflection_page' END,
      CASE WHEN n - 1 < 3 THEN 'scene_count' END, CASE WHEN n - 1 < greatest(3, ceil(words / (210 * 1.25))) THEN 'spread_density' END], lambda v : v IS NOT NULL)) AS rule FROM x
    UNION ALL SELECT book, NULL, 'total_pages' FROM (SELECT book, sum(last - first + 1) AS p FROM x GROUP BY book) WHERE 200 <> 2 + p + 4
    UNION ALL SELECT DISTINCT book, NULL, 'missing_art_direction' FROM x WHERE book % 2 = 0
    UNION ALL SELECT book, pos, 'incomplete_scene' FROM k WHERE scene = 2 AND turn % 3 = 0
    UNION ALL SELECT book, pos, 'scene_pages' FROM k WHERE scene = 1 AND turn % 4 = 1
    UNION ALL SELECT book, pos, 'missing_asset' FROM k WHERE (scene + turn) % 9 = 0
    UNION ALL SELECT book, NULL, 'duplicate_scene_id' FROM k GROUP BY book, scene, pos % 6 HAVING count(*) > 1""")
def r15_review(spark, root):
    """Turns as chapters of an adaptive plan, with faults planted by turn."""
    from pyspark.sql import Window as W

    w = W.partitionBy("book").orderBy("turn")
    t = table(spark, root, "conversations").select(F.col("conv_id").alias("book"), "turn", F.coalesce(F.length("text"), F.lit(0)).alias("words"), F.col("role").alias("title"), (2 + F.col("turn") % 4).alias("n"))
    t = t.withColumns({"pos": F.row_number().over(w), "last": F.sum(2 * F.col("n")).over(w) + 2 - F.when(F.col("turn") % 6 == 5, 1).otherwise(0)})
    t = t.withColumn("start", F.coalesce(F.lag("last").over(w), F.lit(2)) + 1)
    t = t.withColumns({"first": F.col("start") + F.when(F.col("turn") % 7 == 3, 1).otherwise(0), "reflection": F.col("last"), "plan_title": F.when(F.col("turn") % 5 == 4, "other").otherwise(F.col("title"))})
    s = t.select("book", "pos", "turn", "start", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("scene"))
    opening = F.when(F.col("turn") % 4 == 1, F.array(F.col("start") + 9)).otherwise(F.array("start"))
    at = F.col("start") + 1 + 2 * (F.col("scene") - 2)
    scenes = s.select(
        "book", "pos", "scene", F.when((F.col("scene") == 2) & (F.col("turn") % 3 == 0), F.array(F.lit("descricao"))).otherwise(F.array().cast("array<string>")).alias("missing"),
        F.concat_ws("-", F.col("scene").cast("string"), (F.col("pos") % 6).cast("string")).alias("id"), F.when(F.col("scene") == 1, opening).otherwise(F.array(at, at + 1)).alias("pages"),
        F.concat_ws("/", F.col("pos").cast("string"), F.col("scene").cast("string")).alias("asset"), ((F.col("scene") + F.col("turn")) % 9 != 0).alias("asset_exists"),
    )
    full = F.array(*[F.lit(x) for x in X.DIRECTION])
    books = t.select("book").distinct().select("book", F.lit(200).alias("total_pages"), F.when(F.col("book") % 2 == 0, F.slice(full, 1, 3)).otherwise(full).alias("direction"))
    config = {"quantidade_spreads": "adaptativa", "paginas_iniciais": 2, "paginas_finais": 4, "abertura_pagina_unica": True, "fase": "final"}
    return X.plan_review(books, t.drop("turn", "n", "start"), scenes, config)


@query("r17_readability", _FL + ", f AS (SELECT doc_id, CASE WHEN w > 0 THEN round(greatest(0.0, least(100.0, 248.835 - 1.015 * (w / greatest(s, 1)) - 84.6 * (y / w))), 1) ELSE 0.0 END AS f FROM n) SELECT doc_id, 'readability.below_target' AS rule FROM f WHERE f < 60")
def r17(spark, root):
    score = T.flesch(F.col("w"), F.col("s"), F.col("y"))
    low = reading(table(spark, root, "documents")).withColumn("score", score).where("score < 60").withColumns({"line": F.lit(None).cast("int"), "chapter": F.lit(None).cast("string")})
    return A.finding(low, "readability.below_target", "legibilidade", "observacao", 0.8, F.col("score").cast("string"), "The text reads harder than its target.", "Shorten sentences.").select("doc_id", "rule")


@query("r17_group_metrics", "SELECT lang, source, CAST(sum(len(regexp_extract_all(text, '[A-Za-zÀ-úà-ÿ]+'))) AS BIGINT) AS words FROM documents GROUP BY GROUPING SETS ((lang), (lang, source), ())")
def r17_groups(spark, root):
    d = table(spark, root, "documents").select("lang", "source", F.size(T.words(F.col("text"))).alias("w"))
    return d.groupingSets([[d["lang"]], [d["lang"], d["source"]], []], d["lang"], d["source"]).agg(F.sum("w").alias("words"))


@query("i7_reconcile", """
    WITH d AS (SELECT source AS work, doc_id AS doc, lang AS role, doc_id % 9 = 0 AS act, n_chars AS updated FROM documents), a AS (SELECT *, doc % 4 <> 1 AS available, act AND doc % 4 <> 1 AS active FROM d),
    h AS (SELECT work, role, bool_or(active) AS any_active, arg_max(doc, updated * 10000000 + doc) FILTER (WHERE available) AS latest FROM a GROUP BY ALL)
    SELECT work, doc, available, active OR (NOT any_active AND coalesce(doc = latest, false)) AS active FROM a JOIN h USING (work, role)""")
def i7(spark, root):
    d = table(spark, root, "documents").select(F.col("source").alias("work"), F.col("doc_id").alias("doc"), F.col("lang").alias("role"), (F.col("doc_id") % 9 == 0).alias("active"), F.col("n_chars").alias("updated"))
    return K.reconcile(d, d.where("doc % 4 <> 1").select("doc"))


@query("i11_typed_claims", """
    SELECT event_id AS id, 'not_exactly_one' AS issue FROM events WHERE event_id % 7 = 0 UNION ALL SELECT event_id, 'wrong_type' FROM events WHERE event_type = 'click' AND event_id % 7 <> 0""")
def i11(spark, root):
    c = table(spark, root, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("predicate"), F.when(F.col("event_id") % 7 != 0, F.get_json_object("props", "$.k")).alias("value"), F.lit(None).cast("string").alias("object_entity"))
    rules = spark.createDataFrame([("click", "text"), ("view", "number"), ("error", "any")], "predicate string, value_kind string")
    return K.typed_claims(c, rules)


@query("i13_lineage", "SELECT parent, child, max(kind) AS kind FROM (SELECT l_partkey AS parent, l_suppkey AS child, l_returnflag AS kind FROM lineitem) GROUP BY ALL")
def i13(spark, root):
    lines = table(spark, root, "lineitem").select(F.col("l_partkey").alias("parent"), F.col("l_suppkey").alias("child"), F.col("l_returnflag").alias("kind"))
    # As many tasks as the lines need; the aggregate and the join follow this one shuffle.
    e = lines.repartition(tasks_for(spark, lines.count(), 500_000), "parent", "child").groupBy("parent", "child").agg(F.max("kind").alias("kind"))
    return R.upsert(e.where("parent % 2 = 0"), e, ["parent", "child"])


@query("x5_spreads", """
    WITH s AS (SELECT conv_id, row_number() OVER w - 1 AS item, coalesce(length(text), 0) AS n, sum(coalesce(length(text), 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, item::INT AS item, least(floor((run - n + n / 2.0) * 3 / greatest(total, 1))::INT, 2) AS spread FROM s""")
def x5(spark, root):
    t = table(spark, root, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("sizes"))
    return t.select("conv_id", F.posexplode(X.balanced_groups(F.col("sizes"), 3)).alias("item", "spread"))


@query("x6_contents", "SELECT page_id, len(regexp_extract_all(html, '<h1[^>]*>')) AS n FROM pages WHERE contains(html, '<h1')")
def x6(spark, root):
    heads = table(spark, root, "pages").select("page_id", F.explode(X.html_headings(F.col("html"))).alias("h")).select("page_id", "h.level", "h.title")
    return X.contents(heads, 1).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("x10_cover_preflight", "SELECT p_partkey AS cover, CASE WHEN p_size % 3 = 0 THEN 'failed' WHEN p_size < 5 THEN 'warnings' ELSE 'passed' END AS status FROM part")
def x10(spark, root):
    c = table(spark, root, "part").select(F.col("p_partkey").alias("cover"), F.lit("#000000").alias("ink"), F.lit("#ffffff").alias("paper"), F.when(F.col("p_size") % 3 == 0, 1.0).otherwise(3.0).alias("bleed"), F.lit("9780306406157").alias("isbn"), F.col("p_size").alias("spine"))
    return X.cover_preflight(c).select("cover", "status")


@query("x11_config_issues", "SELECT p_partkey, 'isbn' AS field FROM part WHERE p_size % 2 = 0")
def x11(spark, root):
    c = table(spark, root, "part").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 1, "x").alias("isbn"))
    return X.missing_fields(c, "p_partkey", ["title", "isbn"])


@query("x14_prompt_cross", "SELECT n_name || ' in ' || r_name || ' style' AS prompt FROM nation CROSS JOIN region")
def x14(spark, root):
    # Two vocabularies of fixed size.
    pairs = table(spark, root, "nation").select("n_name").crossJoin(F.broadcast(table(spark, root, "region").select("r_name")))
    return pairs.select(F.concat("n_name", F.lit(" in "), "r_name", F.lit(" style")).alias("prompt"))


@query("m6_reading_minutes", "SELECT p_partkey, greatest(1, round(p_partkey / 200.0)::INT) AS minutes FROM part")
def m6_minutes(spark, root):
    return table(spark, root, "part").select("p_partkey", N.reading_minutes(F.col("p_partkey")).alias("minutes"))


@query("s5_union_of_sources", "SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def s5(spark, root):
    c = table(spark, root, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = table(spark, root, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s)


@query("x10_prepress", """
    WITH p AS (SELECT p_partkey AS cover, p_partkey % 7 = 0 AS no_pdf, p_partkey % 2 = 1 AS odd, p_size % 5 = 0 AS bad_isbn, p_size % 4 = 1 AS bad_style, p_size > 45 AS bad_theme, p_size % 3 = 0 AS pale, p_size * 12.0 AS dpi, p_size % 11 = 0 AS no_image, p_size % 6 = 2 AS no_font, p_size / 4.0 AS spine FROM part),
    c AS (SELECT cover, list_filter([
      CASE WHEN no_pdf THEN 'unreadable_interior_pdf' END, CASE WHEN NOT no_pdf AND odd THEN 'odd_page_count' END, CASE WHEN bad_isbn THEN 'invalid_isbn' END, CASE WHEN bad_style THEN 'unknown_typographic_style' END, CASE WHEN bad_theme THEN 'unknown_palette' END,
      CASE WHEN pale THEN 'low_palette_contrast' END, CASE WHEN NOT no_image AND dpi < 150 THEN 'cover_image_low_resolution' END, CASE WHEN NOT no_image AND dpi >= 150 AND dpi < 300 THEN 'cover_image_below_300dpi' END, CASE WHEN no_image THEN 'missing_cover_image' END,
      CASE WHEN no_font THEN 'missing_local_font' END, CASE WHEN spine > 0 AND spine < 6 THEN 'spine_too_narrow_for_text' END, 'rgb_output_pipeline', 'font_reproducibility'], lambda x: x IS NOT NULL) AS codes,
      no_pdf OR bad_isbn OR bad_style OR no_font OR no_image OR dpi < 150 AS failed FROM p)
    SELECT cover, array_to_string(codes, ' ') AS codes, CASE WHEN failed THEN 'failed' ELSE 'passed_with_warnings' END AS status FROM c""")
def x10_prepress(spark, root):
    k, s = F.col("p_partkey"), F.col("p_size")
    # A compact table comes as few tasks: rows are dealt out to all cores, since a review costs more than its row.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    covers = table(spark, root, "part").select("p_partkey", "p_size").repartition(tasks).select(
        k.alias("cover"), F.when(k % 7 != 0, k).alias("page_count"), F.when(s % 5 == 0, "9780306406158").otherwise("0-306-40615-2").alias("isbn"), F.when(s % 4 == 1, "Odd ").otherwise(" Plain").alias("style"), F.lit(None).cast("string").alias("visual_style"),
        F.when(s > 45, "neon").alias("theme"), F.lit("ilustrado_full_bleed").alias("template"), F.create_map(F.lit("bg_color"), F.lit("#ffffff"), F.lit("gold_color"), F.when(s % 3 == 0, "#eeeeee").otherwise("#333333"), F.lit("soft_gold"), F.lit("gold")).alias("palette"),
        F.lit(100).alias("brief_score"), F.array().cast("array<string>").alias("brief_missing"), F.when(s % 11 != 0, s * 12.0).alias("image_dpi"), F.lit(True).alias("has_logo"), F.create_map(F.lit("title"), s % 6 != 2).alias("fonts"), (s / 4.0).alias("spine_mm"), F.lit(6.0).alias("safe_mm"),
    )
    out = cover.prepress(covers, ("plain",), ("nanquim",))
    return out.select("cover", F.array_join(F.transform("issues", lambda x: x["code"]), " ").alias("codes"), "status")


@query("x14_cover_prompts", """
    WITH v AS (SELECT r_regionkey AS k, lower(r_name) AS phrase FROM region)
    SELECT n_nationkey AS brief, n_name || '. ' || CASE WHEN n_nationkey % 4 = 0 THEN 'own style' WHEN n_nationkey % 3 = 0 THEN 'style b' ELSE 'style a' END || '. ' || CASE WHEN n_nationkey % 3 = 0 THEN 'calm' ELSE 'dark, wide' END || '. '
      || coalesce(CASE WHEN n_regionkey < 4 THEN v.phrase END, d.phrase) || ' shot. level. ' || CASE WHEN n_nationkey % 3 = 0 THEN 'soft' ELSE 'hard' END || ' light. thirds. space above.' || CASE WHEN n_nationkey % 2 = 0 THEN ' x, y.' ELSE '' END
      || CASE WHEN n_nationkey % 5 <> 0 THEN ' cover artwork only, no typography, no letters, no words, no logos, no watermark.' ELSE '' END AS prompt
    FROM nation LEFT JOIN v ON v.k = n_regionkey, (SELECT phrase FROM v WHERE k = 0) d""")
def x14_prompts(spark, root):
    """Briefs a nation, shots from the regions' names: the last region's isn't in the vocabulary and takes the default's."""
    n, key = table(spark, root, "nation"), F.col("n_nationkey")
    words = table(spark, root, "region").where("r_regionkey < 4").select(F.lit("shot").alias("kind"), F.when(F.col("r_regionkey") == 0, "medium").otherwise(F.col("r_regionkey").cast("string")).alias("key"), F.concat(F.lower("r_name"), F.lit(" shot")).alias("phrase"))
    fixed = [("angle", "eye_level", "level"), ("lighting", "rembrandt", "hard light"), ("lighting", "soft", "soft light"), ("composition", "rule_of_thirds", "thirds"), ("composition", "negative_space_top", "space above")]
    genres = spark.createDataFrame([("a", "style a", ["dark", "wide"], "rembrandt"), ("b", "style b", ["calm"], "soft")], "genre string, style string, mood array<string>, lighting string")
    no = F.lit(None).cast("string")
    briefs = n.select(
        key.alias("brief"), F.concat("n_name", F.lit("..")).alias("subject"), F.when(key % 3 == 0, "b").when(key % 3 == 1, "a").alias("genre"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey").cast("string")).alias("shot_type"), no.alias("camera_angle"), no.alias("lighting"), no.alias("composition"),
        F.when(key % 4 == 0, "own style").alias("style_override"), F.lit(None).cast("boolean").alias("title_space"), F.when(key % 5 == 0, False).alias("exclude_text"), F.when(key % 2 == 0, F.array(F.lit("x"), F.lit("y"))).alias("extras"),
    )
    return cover.cover_prompts(briefs, words.unionByName(spark.createDataFrame(fixed, "kind string, key string, phrase string")), genres, "a").select("brief", "prompt")
