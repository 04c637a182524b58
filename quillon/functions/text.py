"""Text expressions: tokens, sentences, lines, accents, Markdown, typography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The collation under which case and marks of any script are ignored: keys of joins, groups and comparisons, without Python.
ANY_CASE = "UNICODE_CI_AI"
#: Letters of a word in prose: ASCII and Latin-1 letters.
LETTERS = "A-Za-zÀ-úà-ÿ"
WORD = f"[{LETTERS}]+"
#: Vowels of a syllable group.
VOWELS = "aeiouáàâãéèêíïóôõöúü"

_PLAIN = {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ýÿ"}
_FROM = "".join(_PLAIN.values())
_TO = "".join(k * len(v) for k, v in _PLAIN.items())


def fold(c: Column) -> Column:
    """Lower case without Latin-1 accents. Letters with no plain form stay."""
    return F.translate(F.lower(c), _FROM, _TO)


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts are equal but for case and marks, in any script."""
    return F.collate(a, ANY_CASE) == F.collate(b, ANY_CASE)


def slug(c: Column) -> Column:
    """Plain letters and digits joined by "-"; "" if none."""
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def clean_title(c: Column, entities: tuple[tuple[str, str], ...] = _ENTITIES) -> Column:
    """Tags, entities, escaped dots and emphasis marks off; spaces collapsed."""
    c = F.regexp_replace(c, "<[^>]+>", "")
    for name, char in entities:
        c = F.replace(c, F.lit(name), F.lit(char))
    c = F.replace(c, F.lit("\\."), F.lit("."))
    return F.trim(F.regexp_replace(F.regexp_replace(c, "^[*_\\s]+|[*_\\s]+$", ""), "\\s+", " "))


def words(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def sentences(c: Column) -> Column:
    """Runs up to closing marks, trimmed, that hold a letter."""
    found = F.transform(F.regexp_extract_all(c, F.lit("[^.!?]+(?:[.!?]+|$)"), F.lit(0)), lambda s: F.trim(s))
    return F.filter(found, lambda s: s.rlike(f"[{LETTERS}]"))


def lines(c: Column) -> Column:
    """Lines without their ends; the empty piece after a last newline is no line."""
    parts = F.split(c, "\r\n|\n|\r", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def line_of(c: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(c, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def locate_line(text: Column, excerpt: Column) -> Column:
    """Line of the first occurrence, whatever the case; null if absent."""
    at = F.call_function("locate", F.lower(excerpt), F.lower(text))
    return F.when(at > 0, line_of(text, at - 1))


def squeeze(c: Column, limit: int = 320) -> Column:
    return F.substring(F.regexp_replace(F.trim(c), "\\s+", " "), 1, limit)


def strip_markdown(c: Column) -> Column:
    """Prose without front matter, images, directives, heading marks, quote marks and emphasis."""
    for pattern in (r"(?s)\A---\s*\n.*?\n---\s*\n", r"!\[[^\]]*\]\([^)]*\)", r"(?m)^\s*:::[^\n]*$", r"(?m)^\s*#{1,6}\s+", r"(?m)^\s*>\s*", r"[*_`]"):
        c = F.regexp_replace(c, pattern, "")
    return c


def syllables(word: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit(f"[{VOWELS}]+")))


def count_of(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a plain string."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def matches(c: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of all matches in a short text (a sentence or a line), in characters."""
    both = F.array(F.struct(F.split(c, pattern, -1).alias("p"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("h")))

    def placed(b: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(b["p"], F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(b["h"], F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))
        return F.transform(b["h"], lambda m, i: F.struct(before(i).alias("start"), (before(i) + F.length(m)).alias("end"), m.alias("m")))

    return F.get(F.transform(both, placed), F.lit(0))


def sums_before(sizes: Column, block: int = 256) -> Column:
    """array<int>: to each size the sum of those before it. Folds append to one block at a time, so long lists stay cheap."""
    index = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(index(F.ceil(F.size(sizes) / F.lit(float(block))).cast("int")), lambda b: F.slice(sizes, b * block + 1, F.lit(block)))

    def running(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("pos"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["pos"] + x).alias("pos"), F.array_append(a["out"], a["pos"]).alias("out")), lambda a: a["out"])

    def whole(b: Column) -> Column:
        return F.flatten(F.zip_with(b, running(F.transform(b, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), F.lit(0)), running))

    return F.get(F.transform(F.array(blocks), whole), F.lit(0))


def replace_each(c: Column, pattern: str, by) -> Column:
    """Every match replaced by what ``by`` makes of it: a function from a column to a column."""
    return F.array_join(F.zip_with(F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda p, m: F.concat(p, F.coalesce(by(m), F.lit("")))), "")


def reading_counts(c: Column) -> tuple[Column, Column, Column]:
    """Words, sentences and syllables of prose without Markdown."""
    found = words(c)
    n_sentences = F.size(F.filter(F.split(c, "[.!?]+"), lambda s: s.rlike(WORD)))
    return F.size(found), n_sentences, F.aggregate(found, F.lit(0), lambda a, x: a + syllables(x))


def flesch(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Reading ease for Portuguese, 0 to 100, one decimal; 0 without words."""
    per_sentence = n_words / F.greatest(n_sentences, F.lit(1))
    per_word = n_syllables / F.greatest(n_words, F.lit(1))
    raw = 248.835 - 1.015 * per_sentence - 84.6 * per_word
    return F.when(n_words > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1)).otherwise(0.0)


def reading_class(score: Column) -> Column:
    return F.when(score >= 80, "very easy").when(score >= 60, "easy").when(score >= 50, "medium").otherwise("hard")


# Verbs of saying.
SAYING = (
    "disse", "falou", "respondeu", "gritou", "perguntou", "murmurou",
    "afirmou", "acrescentou", "protestou", "explicou", "resmungou",
    "rosnou", "exclamou", "retrucou", "concordou", "anunciou", "chamou",
)


def typography(line: Column) -> Column:
    """struct(text, n) of one line: dashes of speech made em dashes, verbs of saying after
    them in lower case, double spaces closed up; n counts corrections: one for a leading
    dash, one for dashes within, one a verb, one a pass over double spaces."""

    def named(c: Column, then) -> Column:
        # An array of one gives a value a name, so that it is computed once.
        return F.get(F.transform(F.array(c), then), F.lit(0))

    lead, mid = r"^\s*(?:--|-)\s+", r"\s+--?\s+"
    verb = "— +(" + "|".join(v.capitalize() for v in SAYING) + r")\b"

    def spaces(s: Column, n: Column) -> Column:
        # A pass halves a run of spaces, rounding up: as many passes as its length has doublings.
        widest = F.array_max(F.concat(F.transform(F.regexp_extract_all(s, F.lit(" +"), F.lit(0)), lambda x: F.length(x)), F.array(F.lit(1))))
        passes = F.ceil(F.log2(widest.cast("double"))).cast("int")
        return F.struct(F.regexp_replace(s, " {2,}", " ").alias("text"), (n + passes).alias("n"))

    def verbs(s: Column, n: Column) -> Column:
        hits = F.size(F.regexp_extract_all(s, F.lit("(?U)" + verb), F.lit(0)))
        fixed = s
        for v in SAYING:
            fixed = F.regexp_replace(fixed, "(?U)—\\s+" + v.capitalize() + r"\b", "— " + v)
        return named(fixed, lambda x: spaces(x, n + hits))

    def middle(s: Column, n: Column) -> Column:
        has = s.contains(" - ") | s.contains(" -- ")
        return named(F.when(has, F.regexp_replace(s, mid, " — ")).otherwise(s), lambda x: verbs(x, n + has.cast("int")))

    first = line.rlike(lead)
    return named(F.when(first, F.regexp_replace(line, lead, "— ")).otherwise(line), lambda s: middle(s, first.cast("int")))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, text, chapter, section, context, kind): every line of every document.

    kind: front, blank, heading, rule, directive, image, quote, fence or text.
    context: dialogue for lines that begin with an em dash, else prose. A level-one
    heading starts a chapter and clears the section; levels two and three start one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), lines(F.coalesce(F.col(text_col), F.lit(""))).alias("ls"))
    bare = F.transform("ls", lambda x: F.trim(x))
    closing = F.array_position(F.slice(bare, 2, F.greatest(F.size("ls"), F.lit(1))), "---")
    front = F.when(F.get(bare, F.lit(0)) == "---", F.when(closing > 0, closing + 1).otherwise(F.size("ls"))).otherwise(0)
    rows = rows.select("doc_id", front.alias("front"), F.posexplode("ls").alias("pos", "text")).withColumn("line", F.col("pos") + 1)
    t = F.trim("text")
    head = F.regexp_extract(t, r"^(#{1,3})\s+(.+?)\s*$", 1)
    kind = (
        F.when(F.col("line") <= F.col("front"), "front").when(t == "", "blank").when(head != "", "heading").when(t == "---", "rule").when(t.startswith(":::"), "directive")
        .when(t.startswith("!["), "image").when(t.startswith(">"), "quote").when(t.startswith("```"), "fence").otherwise("text")
    )
    rows = rows.withColumns({"kind": kind, "title": F.regexp_extract(t, r"^#{1,3}\s+(.+?)\s*$", 1), "level": F.length(head)})
    w = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    is_head = F.col("kind") == "heading"
    mark = F.when(is_head & (F.col("level") == 1), F.struct(F.lit(None).cast("string").alias("s"))).when(is_head, F.struct(F.col("title").alias("s")))
    rows = rows.withColumns({
        "chapter": F.last(F.when(is_head & (F.col("level") == 1), F.col("title")), ignorenulls=True).over(w),
        "section": F.last(mark, ignorenulls=True).over(w)["s"],
        "context": F.when(t.startswith("—"), "dialogue").otherwise("prose"),
    })
    return rows.select("doc_id", "line", "text", "chapter", "section", "context", "kind", "level", "title")


def sentence_table(line_rows: DataFrame) -> DataFrame:
    """(doc_id, line, index, chapter, section, context, text) of the sentences of text lines."""
    clean = F.regexp_replace(F.trim("text"), "[*_`]", "")
    return line_rows.where("kind = 'text'").select("doc_id", "line", "chapter", "section", "context", F.posexplode(sentences(clean)).alias("index", "text"))


def replace_word(c: Column, wrong: str, right: str) -> Column:
    """Whole words replaced whatever their case; a capital at their start stays one."""
    body = rf"\b\Q{wrong}\E\b"
    c = F.regexp_replace(c, rf"(?U)(?=\p{{Lu}})(?i:{body})", right[:1].upper() + right[1:])
    return F.regexp_replace(c, rf"(?U)(?!\p{{Lu}})(?i:{body})", right)


def index_tokens(c: Column) -> Column:
    """Tokens of a full-text index: runs of letters and digits, lower case, without accents."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def percent(ratio: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(ratio * 100, digits), F.lit("%"))
