"""Markdown manuscripts as chapters, scenes and passages."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
MARKER = re.compile(r"^<!--\s*(chapter|scene)\s*:?\s*([\w-]+)?(?:\s+title=\"([^\"]*)\")?\s*-->$", re.IGNORECASE)
NAMED = re.compile(r"^(?:cap[ií]tulo|chapter|dia)\s+\S+", re.IGNORECASE)
NUMBERED = re.compile(r"^(?:\d+|[ivxlcdm]+)\s*[.):–—-]", re.IGNORECASE)
STRUCTURAL = re.compile(r"^(?:parte|part|livro|book|volume)\b", re.IGNORECASE)
WORD = re.compile(r"\w+", re.UNICODE)
TARGET_WORDS, OVERLAP = 350, 1
#: Passages that a task hands on at once.
TOGETHER = 1000


def slug(title: str) -> str:
    plain = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


def chapter_level(headings: list[tuple[int, int, str]]) -> int | None:
    """The heading level that holds the chapters; 0 where titles such as "Chapter 1" do, None without any.

    Level two wins if it has three or more headings of which most are numbered, or
    most level-one titles are parts; else level one if it occurs twice; else the
    shallower of the levels one and two that occurs twice most often, else a deeper one.
    """
    if sum(bool(NAMED.match(t)) for _, _, t in headings) >= 2:
        return 0
    by = {n: [t for _, lv, t in headings if lv == n] for n in range(1, 7)}
    share = lambda titles, rule: sum(bool(rule.match(t)) for t in titles) / len(titles) if titles else 0.0
    if len(by[2]) >= 3 and (share(by[2], NUMBERED) >= 0.6 or share(by[1], STRUCTURAL) >= 0.6):
        return 2
    if len(by[1]) >= 2:
        return 1
    often = [n for n in (1, 2) if len(by[n]) >= 2] or [n for n in range(3, 7) if len(by[n]) >= 2]
    if often:
        return max(often, key=lambda n: (len(by[n]), -n))
    return headings[0][1] if headings else None


def paragraph_ranges(content: str) -> list[tuple[int, int]]:
    """Character ranges of runs of lines that aren't blank."""
    return [(m.start(), m.end()) for m in re.finditer(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*", content)]


def chunks(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of paragraphs of about ``target`` words. A chunk takes its first paragraph whatever its
    size, and begins ``overlap`` paragraphs before the last one's end, but always after its start."""
    out, start = [], 0
    while start < len(sizes):
        end, words = start + 1, sizes[start]
        while end < len(sizes) and words < target and words + sizes[end] <= target:
            words += sizes[end]
            end += 1
        out.append((start, end))
        if end >= len(sizes):
            break
        start = max(start + 1, end - min(overlap, end - start - 1))
    return out


def parse(text: str, level: int | None = None, target: int = TARGET_WORDS, overlap: int = OVERLAP) -> list[dict]:
    """Passage rows of a manuscript, with their chapter and scene."""
    text = text.removeprefix("﻿")
    lines = text.splitlines()
    first = 0
    if lines and lines[0].strip() == "---":
        first = next((i + 1 for i in range(1, len(lines)) if lines[i].strip() == "---"), 0)
    fenced, headings, marks = False, [], []
    for i in range(first, len(lines)):
        t = lines[i].strip()
        if t.startswith("```"):
            fenced = not fenced
        elif not fenced and (m := HEADING.match(t)):
            headings.append((i, len(m[1]), m[2]))
        elif not fenced and (m := MARKER.match(t)):
            marks.append((i, m[1].lower(), m[2], m[3]))
    starts: list[tuple[int, str | None, str | None]] = []
    for i, kind, uid, title in marks:
        if kind == "chapter":
            following = next((t for j, _, t in headings if j > i), None)
            starts.append((i, title or following, uid))
    if not starts:
        at = level if level is not None else chapter_level(headings)
        chosen = [h for h in headings if (NAMED.match(h[2]) if at == 0 else h[1] == at)]
        starts = [(i, t, None) for i, _, t in chosen]
        ahead = [x for x in lines[first : starts[0][0]]] if starts else []
        if not starts:
            starts = [(first, "Documento", None)]
        elif any(x.strip() and not MARKER.match(x.strip()) for x in ahead):
            starts.insert(0, (first, "Preâmbulo", None))
    rows, seen = [], {}
    for c, (begin, title, uid) in enumerate(starts):
        stop = starts[c + 1][0] if c + 1 < len(starts) else len(lines)
        base = slug(title or "") or "chapter"
        seen[base] = seen.get(base, 0) + 1
        key = base if seen[base] == 1 else f"{base}-{seen[base]}"
        cuts = [(i, u, t) for i, kind, u, t in marks if kind == "scene" and begin <= i < stop]
        scenes = [(i + 1, u, t) for i, u, t in cuts]
        if not scenes or any(x.strip() and not HEADING.match(x.strip()) and not MARKER.match(x.strip()) for x in lines[begin : cuts[0][0]]):
            scenes.insert(0, (begin, None, None))
        for s, (s_begin, s_uid, s_title) in enumerate(scenes):
            s_stop = scenes[s + 1][0] - 1 if s + 1 < len(scenes) else stop
            content = "\n".join(lines[s_begin:s_stop]).strip("\n")
            shift = next((k for k in range(s_begin, s_stop) if lines[k].strip()), s_begin)
            spans = paragraph_ranges(content)
            sizes = [len(WORD.findall(content[a:b])) for a, b in spans]
            for p, (a, b) in enumerate(chunks(sizes, target, overlap)):
                lo, hi = spans[a][0], spans[b - 1][1]
                body = content[lo:hi]
                rows.append({
                    "chapter": c, "chapter_key": key, "chapter_uid": uid, "chapter_title": title, "scene": s, "scene_uid": s_uid, "scene_title": s_title,
                    "scene_sha256": hashlib.sha256(content.encode()).hexdigest(), "passage": p, "start_offset": lo, "end_offset": hi,
                    "start_line": shift + 1 + content.count("\n", 0, lo), "end_line": shift + 1 + content.count("\n", 0, max(lo, hi - 1)),
                    "content": body, "content_sha256": hashlib.sha256(body.encode()).hexdigest(), "token_count": len(WORD.findall(body)),
                })
    return rows


SCHEMA = (
    "doc_id long, chapter int, chapter_key string, chapter_uid string, chapter_title string, scene int, scene_uid string, scene_title string, scene_sha256 string, passage int, "
    "start_offset int, end_offset int, start_line int, end_line int, content string, content_sha256 string, token_count int"
)


def passages(docs: DataFrame, level: int | None = None, target: int = TARGET_WORDS, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passage rows of every manuscript. Parsing is stateful, so it runs on whole texts in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])
        own: list[dict] = []
        for batch in batches:
            for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                own += [{"doc_id": d.as_py(), **r} for r in parse(t.as_py() or "", level, target, overlap)]
                for at in range(0, len(own) - TOGETHER + 1, TOGETHER):
                    yield pa.RecordBatch.from_pylist(own[at : at + TOGETHER], schema)
                own = own[len(own) // TOGETHER * TOGETHER :]
        if own:
            yield pa.RecordBatch.from_pylist(own, schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
