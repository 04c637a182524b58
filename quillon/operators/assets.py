"""Transforms of the production stages: HTML and Markdown sections, prompts, preflight, layout arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import numeric as N
from quillon.functions import text as T


def front_matter(c: Column) -> tuple[Column, Column]:
    """(front matter, body) of a Markdown text."""
    block = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)"
    return F.regexp_extract(c, block, 1), F.regexp_replace(c, block, "")


def chapters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", implicit: str = "Introdução") -> DataFrame:
    """(doc_id, chapter, title, body): split at level-one headings; what comes before the first is an implicit chapter."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?m)^# +", -1)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("chapter", "part"))
    title = F.when(F.col("chapter") == 0, implicit).otherwise(F.trim(F.substring_index("part", "\n", 1)))
    body = F.when(F.col("chapter") == 0, F.col("part")).otherwise(F.regexp_replace("part", r"\A[^\n]*\n?", ""))
    return rows.select("doc_id", "chapter", title.alias("title"), F.trim(body).alias("body")).where("chapter > 0 OR body <> ''")


def named_section(c: Column, name: str) -> Column:
    """The text below a heading of any level up to the next heading."""
    return F.regexp_replace(F.regexp_extract(c, rf"(?ms)^#{{1,6}}\s+{name}\s*\n(.*?)(?=^#{{1,6}}\s|\z)", 1), r"\A\s+|\s+\z", "")


def html_text(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def html_headings(c: Column) -> Column:
    """array<struct<level, title>> in order."""
    found = F.regexp_extract_all(c, F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"), F.lit(0))
    return F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), T.clean_title(h).alias("title")))


def wide_tables(c: Column, columns: int = 6) -> Column:
    """Tables whose first row has at least so many cells: they want a landscape page."""
    tables = F.regexp_extract_all(c, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))
    first = lambda t: F.regexp_extract(t, r"(?is)<tr\b.*?</tr>", 0)
    return F.size(F.filter(tables, lambda t: F.size(F.regexp_extract_all(first(t), F.lit(r"(?i)<t[dh]\b"), F.lit(0))) >= columns))


def page_summary(pages: DataFrame) -> DataFrame:
    """(page_id, headings, words, minutes, wide_tables)."""
    words = F.size(F.filter(F.split(html_text(F.col("html")), " "), lambda w: w != ""))
    return pages.select("page_id", F.size(html_headings(F.col("html"))).alias("headings"), words.alias("words"), N.reading_minutes(words).alias("minutes"), wide_tables(F.col("html")).alias("wide_tables"))


def typst_line(line: Column) -> Column:
    """A Markdown line as Typst markup."""
    bare = F.replace(F.regexp_replace(line, r"<[^>]+>", ""), F.lit("@"), F.lit("\\@"))
    level = F.length(F.regexp_extract(bare, r"^(#{1,6})\s", 1))
    title = F.regexp_replace(bare, r"^#{1,6}\s+", "")
    strong = lambda x: F.regexp_replace(x, r"\*\*(.+?)\*\*", "*$1*")
    return (
        F.when(level > 0, F.concat(F.repeat(F.lit("="), level), F.lit(" "), title)).when(bare.startswith("> "), F.concat(F.lit("#quote["), strong(F.substring(bare, F.lit(3), F.length(bare))), F.lit("]")))
        .when(F.trim(bare) == "---", "#line(length: 100%)").otherwise(strong(bare))
    )


def greedy_chunks(sizes: Column, target: int, overlap: int = 1) -> Column:
    """array<struct<start, end>> (end exclusive): paragraphs gathered up to a budget, see the manuscript source.

    The greedy reset has no window form, so it is a fold over the array of a scene's sizes.
    """
    n = F.size(sizes)
    kind = "array<struct<s:int,e:int>>"
    total = lambda a, b: F.aggregate(F.slice(sizes, a + 1, b - a), F.lit(0), lambda x, y: x + y)

    def step(acc: Column, i: Column) -> Column:
        full = (total(acc["s"], i) >= target) | (total(acc["s"], i) + F.get(sizes, i) > target)
        back = F.greatest(acc["s"] + 1, i - F.least(F.lit(overlap), i - acc["s"] - 1))
        cut = F.struct(back.alias("s"), F.array_append(acc["out"], F.struct(acc["s"].alias("s"), i.alias("e"))).alias("out"))
        # A chunk that has just been cut may have to be cut at once again: its carried paragraphs fill the budget.
        return F.when(full & (i > acc["s"]), cut).otherwise(acc)

    def settle(acc: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(overlap)), acc, lambda a, _: step(a, i))

    zero = F.struct(F.lit(0).alias("s"), F.array().cast(kind).alias("out"))
    idx = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(idx, zero, settle, lambda a: F.array_append(a["out"], F.struct(a["s"].alias("s"), n.alias("e"))))
    return F.when(n > 0, done).otherwise(F.array().cast(kind))


def best_split(sizes: Column) -> Column:
    """How many leading items come nearest to half of the total; the smallest such number."""
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.size(sizes) - 1, F.lit(1))), lambda i: F.struct(F.abs(total - 2 * F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)).alias("d"), i.alias("i")))
    return F.array_min(at)["i"]


def missing_fields(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field) of empty required fields."""
    gone = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return rows.select(id_col, F.explode(gone).alias("field"))


def preflight(assets: DataFrame, min_dpi: float = 300.0, warn_dpi: float = 200.0, max_delta: float = 0.02) -> DataFrame:
    """(asset, issues, status) of assets (asset, w, h, mode, has_icc, mm_w, mm_h): failed, warnings or passed."""
    dpi = F.least(N.effective_dpi(F.col("w"), F.col("mm_w")), N.effective_dpi(F.col("h"), F.col("mm_h")))
    delta = N.aspect_delta(F.col("w"), F.col("h"), F.col("mm_w"), F.col("mm_h"))
    rules = [(dpi < warn_dpi, "error:resolution"), ((dpi >= warn_dpi) & (dpi < min_dpi), "warning:resolution"), (delta > max_delta, "error:aspect"),
             (~F.col("mode").isin("RGB", "CMYK", "L"), "error:mode"), (~F.col("has_icc"), "warning:profile")]
    issues = F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in rules]), lambda x: x.isNotNull())
    status = F.when(F.exists(issues, lambda x: x.startswith("error")), "failed").when(F.size(issues) > 0, "warnings").otherwise("passed")
    return assets.select("asset", issues.alias("issues"), status.alias("status"))


def cover_segments(covers: DataFrame) -> DataFrame:
    """(cover, segment, x, width) from left to right of covers (cover, page_w, spine, flap): flaps only if there are any."""
    widths = [("back_flap", "flap"), ("back", "page_w"), ("spine", "spine"), ("front", "page_w"), ("front_flap", "flap")]
    parts = F.array(*[F.struct(F.lit(name).alias("segment"), F.col(c).cast("double").alias("width")) for name, c in widths])
    kept = F.filter(parts, lambda p: p["width"] > 0)
    rows = covers.select("cover", F.posexplode(F.transform(kept, lambda p, i: F.struct(p["segment"].alias("segment"), p["width"].alias("width"), F.aggregate(F.slice(kept, F.lit(1), i), F.lit(0.0), lambda a, q: a + q["width"]).alias("x")))).alias("pos", "p"))
    return rows.select("cover", "p.segment", "p.x", "p.width")


def prompt(parts: list[tuple[str, Column]]) -> Column:
    """Labelled parts of a prompt, empty ones left out."""
    return F.concat_ws(". ", *[F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), F.trim(c))) for name, c in parts])


def title_lines(title: Column, width: int) -> Column:
    """A title broken into lines of at most ``width`` characters where words allow."""

    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = F.length(last) + 1 + F.length(w) <= width
        return F.when(last == "", F.array(w)).when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.array_append(acc, w))

    return F.aggregate(F.split(F.trim(title), r"\s+"), F.array(F.lit("")), step)


def balanced_groups(sizes: Column, k: int) -> Column:
    """For each item the number of its group: k runs whose ends lie where the running total passes equal shares."""
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    kind = "array<int>"
    zero = F.struct(F.lit(0).alias("run"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # An item belongs where its middle falls.
        middle = (acc["run"] + x / 2) * k / F.greatest(total, F.lit(1))
        return F.struct((acc["run"] + x).alias("run"), F.array_append(acc["out"], F.least(F.floor(middle).cast("int"), F.lit(k - 1))).alias("out"))

    return F.aggregate(sizes, zero, step, lambda a: a["out"])


def plan_pages(scenes: DataFrame, first_page: int = 1) -> DataFrame:
    """Chapters (book, chapter, pages, scenes) with first and last page, and scenes a page."""
    from pyspark.sql import Window as W

    run = F.sum("pages").over(W.partitionBy("book").orderBy("chapter").rowsBetween(W.unboundedPreceding, W.currentRow))
    end = run + first_page - 1
    return scenes.withColumns({"first": end - F.col("pages") + 1, "last": end, "density": F.round(F.col("scenes") / F.greatest(F.col("pages"), F.lit(1)), 4)})


def plan_issues(plan: DataFrame, low: float, high: float) -> DataFrame:
    """(book, chapter, issue): density out of range, no pages, or a title used twice in a book."""
    twice = plan.groupBy("book", F.lower("title").alias("_t")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = plan.withColumn("_t", F.lower("title")).join(twice, ["book", "_t"], "left")
    rules = [(F.col("pages") <= 0, "no_pages"), ((F.col("pages") > 0) & ~F.col("density").between(low, high), "density"), (F.col("_n").isNotNull(), "duplicate_title")]
    return rows.select("book", "chapter", F.explode(F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in rules]), lambda x: x.isNotNull())).alias("issue"))


# What a plan's art direction covers, and what a scene's sheet holds.
DIRECTION = ("estilo_ilustracao", "fotografia", "cinematografia", "cenografia", "cor_e_luz")
SHEET = ("id", "tipo", "paginas", "funcao", "ancora_textual", "descricao", "zona_texto", "personagens", "elementos_continuidade", "alt_texto", "arquivo", "status")
MODES = ("sem_imagens", "abertura_pagina_par", "totalmente_ilustrado")
# What a plan's configuration says unless it says otherwise.
PLAN = {
    "modo": "totalmente_ilustrado", "quantidade_spreads": "fixa", "paginas_por_capitulo": 0, "cenas_por_capitulo": 0, "min_spreads_por_capitulo": 3, "palavras_por_spread_referencia": 210,
    "tolerancia_superior_densidade": 1.25, "paginas_iniciais": 0, "paginas_finais": 0, "inicio_capitulo_impar": False, "abertura_pagina_unica": False, "cenas_internas_em_spread": 0, "fase": "planejamento",
}


def plan_review(books: DataFrame, chapters: DataFrame, scenes: DataFrame, config: dict | None = None) -> DataFrame:
    """(book, chapter, rule): faults of illustration plans against their manuscripts; rule codes without "structure.illustration_plan.".

    books (book, total_pages, direction: array of names). chapters (book, pos from 1,
    title, words: of the manuscript without reflections, or null; plan_title, first,
    last, reflection: of the plan, or null). scenes (book, pos, scene from 1, missing:
    array of empty fields, id, pages, asset, asset_exists). ``config``: keys of ``PLAN``.
    """
    c = PLAN | (config or {})
    issue = lambda df, chapter, rule: df.select("book", chapter.cast("int").alias("chapter"), F.lit(rule).alias("rule"))
    none = F.lit(None)
    if c["modo"] not in MODES:
        return issue(books, none, "invalid_mode")
    if c["modo"] == "sem_imagens":
        return issue(books.limit(0), none, "invalid_mode")
    from pyspark.sql import Window as W

    adaptive, least = str(c["quantidade_spreads"]).lower() == "adaptativa", c["min_spreads_por_capitulo"]
    n = scenes.groupBy("book", "pos").agg(F.count(F.lit(1)).alias("n"))
    ch = chapters.join(n, ["book", "pos"], "left").na.fill(0, ["n"])
    front, per = c["paginas_iniciais"], c["paginas_por_capitulo"]
    start = F.coalesce(F.lag("last").over(W.partitionBy("book").orderBy("pos")), F.lit(front)) + 1 if adaptive else front + (F.col("pos") - 1) * per + 1
    length = 2 + 2 * F.greatest(F.lit(0), F.col("n") - 1) if adaptive else F.lit(per)
    ch = ch.withColumn("start", start).withColumns({"end": F.col("start") + length - 1, "spreads": F.greatest(F.lit(0), F.col("n") - 1)})
    both = ch.where("title IS NOT NULL AND first IS NOT NULL")
    planned, written = F.count("first"), F.count("title")
    pages = F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0)) if adaptive else written * per
    totals = books.join(ch.groupBy("book").agg(planned.alias("planned"), written.alias("written"), pages.alias("pages")), "book", "left").na.fill(0, ["planned", "written", "pages"])
    wrong = (F.col("first") != F.col("start")) | (F.col("last") != F.col("end"))
    odd = (F.col("start") % 2 != 1) if c["inicio_capitulo_impar"] else F.lit(False)
    count = F.col("spreads") < least if adaptive else F.col("n") != c["cenas_por_capitulo"]
    dense = F.lit(False)
    if adaptive and c["palavras_por_spread_referencia"] > 0 and c["tolerancia_superior_densidade"] > 0:
        dense = F.col("spreads") < F.greatest(F.lit(least), F.ceil(F.col("words") / (c["palavras_por_spread_referencia"] * c["tolerancia_superior_densidade"])))
    rules = [(F.col("title") != F.col("plan_title"), "chapter_mismatch"), (wrong | odd, "page_geometry"), (~F.col("reflection").eqNullSafe(F.col("end")), "reflection_page"), (count, "scene_count"), (dense, "spread_density")]
    several = lambda df, tests, *keys: df.select(*keys, F.explode(F.filter(F.array(*[F.when(t, F.lit(name)) for t, name in tests]), lambda x: x.isNotNull())).alias("rule"))
    out = several(both, rules, "book", F.col("pos").cast("int").alias("chapter"))
    lacking = F.size(F.array_except(F.array(*[F.lit(x) for x in DIRECTION]), F.coalesce("direction", F.array().cast("array<string>")))) > 0
    whole = [(F.col("total_pages") != front + F.col("pages") + c["paginas_finais"], "total_pages"), (lacking, "missing_art_direction"), (F.col("planned") != F.col("written"), "chapter_count")]
    out = out.unionByName(several(totals, whole, "book", none.cast("int").alias("chapter")))
    # Where a scene should stand: an opening page of its own if there is one, then spreads.
    sc = scenes.join(both.select("book", "pos", "start", "spreads"), ["book", "pos"])
    k, most = F.col("scene"), F.col("spreads") if adaptive else F.lit(c["cenas_internas_em_spread"])
    if c["modo"] == "abertura_pagina_par":
        want = F.when(k == 1, F.array(F.col("start") - 1))
    else:
        lead = 1 if c["abertura_pagina_unica"] else 0
        at = F.col("start") + lead + 2 * (k - 1 - lead)
        want = F.when((k == 1) & F.lit(bool(lead)), F.array("start")).when(k <= most + lead, F.array(at, at + 1))
    making = F.lit(str(c["fase"]).lower() in ("producao", "produção", "final"))
    own = [(F.size("missing") > 0, "incomplete_scene"), (want.isNotNull() & ~F.coalesce(F.col("pages").cast("array<long>") == want.cast("array<long>"), F.lit(False)), "scene_pages"), (making & F.col("asset").isNotNull() & ~F.col("asset_exists"), "missing_asset")]
    out = out.unionByName(several(sc, own, "book", F.col("pos").cast("int").alias("chapter")))
    for column, rule in (("id", "duplicate_scene_id"), ("asset", "duplicate_asset")):
        twice = sc.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy("book", column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(issue(twice, none, rule))
    return out


def cover_preflight(covers: DataFrame, least_contrast: float = 4.5, least_bleed: float = 3.0) -> DataFrame:
    """(cover, issues, status) of covers (cover, ink, paper, bleed, isbn, spine): colours, bleed, ISBN and spine."""
    from quillon.functions.hashing import isbn13

    rules = [(N.contrast(F.col("ink"), F.col("paper")) < least_contrast, "error:contrast"), (F.col("bleed") < least_bleed, "error:bleed"), (isbn13(F.col("isbn")).isNull(), "error:isbn"), (F.col("spine") < 5, "warning:spine_text")]
    issues = F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in rules]), lambda x: x.isNotNull())
    status = F.when(F.exists(issues, lambda x: x.startswith("error")), "failed").when(F.size(issues) > 0, "warnings").otherwise("passed")
    return covers.select("cover", issues.alias("issues"), status.alias("status"))


def contents(headings: DataFrame, deepest: int = 2, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Headings (level, title) of a table of contents."""
    return headings.where((F.col("level") <= deepest) & ~F.lower("title").isin([h.lower() for h in hidden] or [""]))
