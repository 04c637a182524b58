"""Covers: the prepress review of each, and prompts from briefs and a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import numeric as N
from quillon.functions.hashing import isbn13

#: Colours of a palette that stand on its background.
ROLES = ("gold_color", "soft_gold", "text_light")
FONT_ROLES = ("title", "body", "tag")
#: What prompts without lettering add and exclude.
NO_TEXT = "cover artwork only, no typography, no letters, no words, no logos, no watermark"
AVOID_TEXT, AVOID_FIGURES = "text, letters, words, logo, watermark, signature", "photographic background, human figures"
#: Kinds of phrases of a vocabulary, the column of a brief that picks one, and what counts where it picks none that is known.
KINDS = (("shot", "shot_type", "medium"), ("angle", "camera_angle", "eye_level"), ("lighting", "lighting", "rembrandt"), ("composition", "composition", "rule_of_thirds"))
TITLE_SPACE = "negative_space_top"


def prepress(covers: DataFrame, styles: tuple[str, ...], palettes: tuple[str, ...], least_contrast: float = 3.0) -> DataFrame:
    """(cover, issues, status): what stands against printing each cover.

    ``covers``: cover, page_count (null: the interior can't be read), isbn, style,
    visual_style, theme, template, palette (map of role to "#rrggbb"), brief_score,
    brief_missing (array), image_dpi (null: no image), has_logo, fonts (map of role to
    whether its file is there), spine_mm, safe_mm. An issue is (severity, code, detail).
    Palettes are checked role by role; a colour that can't be read has no contrast.
    """
    # Each rule is an array of one issue or of none: they are joined without a lambda, which would be interpreted.
    none = F.array().cast("array<struct<severity:string,code:string,detail:string>>")
    said = lambda severity, code, broken, detail=None: F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")))).otherwise(none)
    name = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    theme = F.when(F.col("theme").isNull(), "nanquim").otherwise(name("theme"))
    hexed = lambda c: F.when(c.rlike("^#[0-9A-Fa-f]{6}$"), c)
    # Columns of their own, so that each is computed once a row.
    covers = covers.withColumns({f"_{r}": N.luminance(hexed(F.col("palette")[r])) for r in (*ROLES, "bg_color")})
    covers = covers.withColumns({f"_{r}": N.ratio(F.col(f"_{r}"), F.col("_bg_color")) for r in ROLES})
    ratio = lambda role: F.col(f"_{role}")
    fonts = F.coalesce(F.col("fonts"), F.create_map().cast("map<string,boolean>"))
    dpi = F.col("image_dpi")
    rules = [
        said("error", "unreadable_interior_pdf", F.col("page_count").isNull()),
        said("warning", "odd_page_count", F.col("page_count") % 2 == 1, F.col("page_count")),
        said("error", "invalid_isbn", isbn13(F.col("isbn")).isNull(), F.col("isbn")),
        said("error", "unknown_typographic_style", (name("style") != "") & ~name("style").isin(*styles), name("style")),
        said("error", "unknown_visual_style", (name("visual_style") != "") & ~name("visual_style").isin(*styles), name("visual_style")),
        said("warning", "unknown_palette", ~theme.isin(*palettes), theme),
        said("info", "incomplete_editorial_brief", F.col("brief_score") < 100, F.array_join("brief_missing", ", ")),
        *[said("warning", "low_palette_contrast", ratio(r) < least_contrast, F.format_string(f"{r} %.2f", F.round(ratio(r), 2))) for r in ROLES],
        said("error", "cover_image_low_resolution", dpi < 150, dpi),
        said("warning", "cover_image_below_300dpi", (dpi >= 150) & (dpi < 300), dpi),
        said("error", "missing_cover_image", dpi.isNull() & F.col("template").contains("ilustrado")),
        said("warning", "missing_publisher_logo", ~F.coalesce("has_logo", F.lit(False))),
        *[said("error", "missing_local_font", ~fonts[r], F.lit(r)) for r in FONT_ROLES],
        said("warning", "spine_too_narrow_for_text", (F.col("spine_mm") > 0) & (F.col("spine_mm") < 6), F.col("spine_mm")),
        said("warning", "small_safe_area", F.col("safe_mm") < 5, F.col("safe_mm")),
        # What comes out is RGB, whatever the cover: the printer's profile is a step of its own.
        said("warning", "rgb_output_pipeline", F.lit(True)),
        said("info", "font_reproducibility", F.size(fonts) < 3),
    ]
    issues = F.concat(*rules)
    worst = lambda s: F.exists("issues", lambda x: x["severity"] == s)
    status = F.when(worst("error"), "failed").when(worst("warning"), "passed_with_warnings").otherwise("passed")
    return covers.select("cover", issues.alias("issues")).withColumn("status", status)


def aspect_ratio(width: Column, height: Column, most: int = 50) -> Column:
    """The fraction nearest to width / height with a denominator of at most ``most``, as "w:h"; of equally near ones the smallest."""
    x = width / height
    near = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda d: F.struct(F.abs(x - F.round(x * d) / d).alias("off"), d.alias("d"), F.round(x * d).cast("int").alias("n")))
    best = F.array_min(near)
    return F.when(height > 0, F.concat(best["n"].cast("string"), F.lit(":"), best["d"].cast("string")))


def cover_prompts(briefs: DataFrame, vocabulary: DataFrame, genres: DataFrame, default_genre: str) -> DataFrame:
    """(brief, prompt, avoid, shot_type, camera_angle, lighting, composition, genre): a prompt for each brief.

    ``briefs``: brief, subject, genre, shot_type, camera_angle, lighting, composition,
    style_override, title_space, exclude_text, extras (array); nulls take the
    defaults. ``vocabulary``: kind, key, phrase; ``genres``: genre, style, mood
    (array), lighting. Both are small lookups, joined under a role each; a word that
    the vocabulary doesn't know is replaced by the default's phrase.
    """
    b = briefs.join(F.broadcast(genres.select(F.col("genre").alias("g"), F.struct("style", "mood", "lighting").alias("own"))), F.col("genre") == F.col("g"), "left")
    fallback = genres.where(F.col("genre") == default_genre).select(F.struct("style", "mood", "lighting").alias("usual")).limit(1)
    b = b.crossJoin(F.broadcast(fallback)).withColumn("look", F.coalesce("own", "usual"))  # one row
    b = b.withColumn("lighting", F.coalesce("lighting", "look.lighting"))
    for kind, col, usual in KINDS:
        words = vocabulary.where(F.col("kind") == kind)
        first = words.where(F.col("key") == usual).select(F.first("phrase").alias(f"_{kind}0"))
        b = b.withColumn(col, F.coalesce(col, F.lit(usual))).join(F.broadcast(words.select(F.col("key").alias(col), F.col("phrase").alias(f"_{kind}"))), col, "left").crossJoin(F.broadcast(first))
        b = b.withColumn(f"_{kind}", F.coalesce(f"_{kind}", f"_{kind}0")).drop(f"_{kind}0")
    space = vocabulary.where((F.col("kind") == "composition") & (F.col("key") == TITLE_SPACE)).select(F.first("phrase").alias("_space"))
    b = b.crossJoin(F.broadcast(space))
    bare = F.coalesce("exclude_text", F.lit(True))
    parts = F.array(
        F.regexp_replace(F.trim("subject"), r"\.+$", ""), F.coalesce("style_override", "look.style"), F.array_join("look.mood", ", "), "_shot", "_angle", "_lighting", "_composition",
        F.when(F.coalesce("title_space", F.lit(True)) & (F.col("composition") != TITLE_SPACE), F.col("_space")), F.array_join("extras", ", "), F.when(bare, NO_TEXT),
    )
    text = F.concat(F.array_join(F.filter(parts, lambda p: F.coalesce(p != "", F.lit(False))), ". "), F.lit("."))
    return b.select("brief", text.alias("prompt"), F.when(bare, AVOID_TEXT).otherwise(AVOID_FIGURES).alias("avoid"), "shot_type", "camera_angle", "lighting", "composition", F.coalesce(F.col("g"), F.lit(default_genre)).alias("genre"))
