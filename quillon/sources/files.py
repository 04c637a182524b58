"""File sources and sinks: YAML rules, JSON lines, probes, atomic datasets."""

from __future__ import annotations

import re
import struct
import time
import uuid
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.sources.lease import Lease, LeaseLost


#: A writer's options for very many small files: on a local disk none gets a checksum file beside it, which Hadoop makes as slowly as the file itself.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


#: Up to so many paths are listed by the driver.
_FEW = "spark.sql.sources.parallelPartitionDiscovery.threshold"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; a byte-order mark is stripped, files that aren't UTF-8 or are empty are left out."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.expr("try_validate_utf8(cast(content AS string))")
    return raw.select("path", F.regexp_replace(text, "^﻿", "").alias("text")).where("text IS NOT NULL AND trim(text) <> ''")


def yaml_config(spark: SparkSession, path: str) -> dict:
    """One small YAML file, read through Spark's file systems and parsed on the driver."""
    try:
        import yaml
    except ImportError as err:  # optional dependency
        raise RuntimeError("reading YAML needs PyYAML") from err
    rows = spark.read.text(path, wholetext=True).collect()
    return yaml.safe_load(rows[0][0]) if rows else {}


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log with a fixed schema; the order is a column of the schema, not the file's."""
    return spark.read.schema(schema).json(path)


def probe(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """(path, sha256, n_lines, n_bytes) of every file that isn't empty; with ``deep`` also in folders below those that ``path`` names, each of which a task lists."""
    few = spark.conf.get(_FEW)
    if deep:
        # However few the folders are: else the driver lists them one by one, with a job for those in each.
        spark.conf.set(_FEW, "0")
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(path)
    finally:
        spark.conf.set(_FEW, few)
    text = F.col("content").cast("string")
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n") | (text == ""), 0).otherwise(1)
    return raw.select("path", F.sha2("content", 256).alias("sha256"), n.alias("n_lines"), F.col("length").alias("n_bytes"))


def _hadoop(spark: SparkSession, path: str):
    """(file system, path class) of a path."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path_of


def _move(fs, path_of, source: str, target: str) -> None:
    if not fs.rename(path_of(source), path_of(target)):
        raise OSError(f"{source} can't be moved to {target}")


def _siblings(fs, path_of, path: str, mark: str) -> list[str]:
    """Paths named ``path``.<mark>-..., oldest first."""
    found = fs.globStatus(path_of(f"{path}.{mark}-*"))
    return sorted(str(x.getPath()) for x in found) if found else []


def recover(spark: SparkSession, path: str) -> None:
    """After a crash between the two renames of a swap, put the old dataset back."""
    fs, path_of = _hadoop(spark, path)
    old = _siblings(fs, path_of, path, "old")
    if old and not fs.exists(path_of(path)):
        _move(fs, path_of, old[-1], path)


def write_atomic(df: DataFrame, path: str, lease: Lease | None = None) -> None:
    """Write beside ``path``, then swap it in by rename; a failed write or rename leaves the old dataset.

    With a ``lease``, a writer that has lost it by the time of the swap is refused.
    Should the process die between the two renames, the next ``write_atomic`` or ``recover`` puts the old one back.
    """
    spark = df.sparkSession
    recover(spark, path)
    fs, path_of = _hadoop(spark, path)
    stage, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{time.time_ns():020d}"
    df.write.parquet(stage)
    if lease:
        try:
            lease.check()
        except LeaseLost:
            fs.delete(path_of(stage), True)
            raise
    there = fs.exists(path_of(path))
    if there:
        _move(fs, path_of, path, old)
    try:
        _move(fs, path_of, stage, path)
    except OSError:
        if there:
            _move(fs, path_of, old, path)
        raise
    for gone in _siblings(fs, path_of, path, "old"):
        fs.delete(path_of(gone), True)


def backup(spark: SparkSession, path: str) -> str:
    """Copy a dataset to ``path``.backup-<time>; that name is the result."""
    fs, path_of = _hadoop(spark, path)
    target = f"{path}.backup-{time.time_ns():020d}"
    util = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    if not util.copy(fs, path_of(path), fs, path_of(target), False, True, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"{path} can't be copied")
    return target


def backups(spark: SparkSession, path: str) -> list[str]:
    """The backups of a dataset, oldest first."""
    return _siblings(*_hadoop(spark, path), path, "backup")


def prune(spark: SparkSession, path: str, keep: int = 5) -> list[str]:
    """Delete all but the newest ``keep`` backups; those that went are the result."""
    fs, path_of = _hadoop(spark, path)
    gone = backups(spark, path)[: -keep or None] if keep > 0 else backups(spark, path)
    for name in gone:
        fs.delete(path_of(name), True)
    return gone


def restore(spark: SparkSession, saved: str, path: str) -> None:
    """Swap a backup in for the dataset."""
    write_atomic(spark.read.parquet(saved), path)


def rebuild(spark: SparkSession, sources: str, path: str, build: Callable[[DataFrame], DataFrame], keep: int | None = 5) -> str | None:
    """Make the dataset at ``path`` anew from whole files (path, text) and swap it in; the old one is backed up first, unless ``keep`` is None.

    Without any source the old dataset stays and an error is raised.
    """
    there, at = _hadoop(spark, sources)
    rows = texts(spark, sources) if there.globStatus(at(sources)) else None
    if rows is None or rows.isEmpty():
        raise FileNotFoundError(f"no source to rebuild from: {sources}")
    recover(spark, path)
    fs, path_of = _hadoop(spark, path)
    saved = backup(spark, path) if keep is not None and fs.exists(path_of(path)) else None
    write_atomic(build(rows), path)
    if keep is not None:
        prune(spark, path, keep)
    return saved


def write_report(df: DataFrame, path: str) -> None:
    """Findings as JSON lines."""
    df.write.mode("overwrite").json(path)


def markdown_report(findings: DataFrame, most: int = 100, title: str = "Review") -> DataFrame:
    """(doc_id, report): a document's findings as a Markdown text, worst severity and first line first.

    At most ``most`` are listed; the heading says how many there are.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in ("bloqueador", "erro", "alerta", "observacao", "informacao")]), F.col("severity"))
    n = F.count(F.lit(1)).over(W.partitionBy("doc_id"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(rank, F.coalesce("line", F.lit(0)), "rule", "id"))
    rows = findings.withColumns({"_n": n, "_k": place}).where(F.col("_k") <= most)
    where = F.concat_ws(", ", F.col("chapter"), F.concat(F.lit("line "), F.col("line").cast("string")))
    item = F.concat(
        F.lit("## "), "severity", F.lit(": `"), "rule", F.lit("`\n\n"), F.when(where != "", F.concat(where, F.lit("\n\n"))).otherwise(""),
        F.lit("> "), "excerpt", F.lit("\n\n"), "explanation", F.coalesce(F.concat(F.lit("\n\n*"), "suggestion", F.lit("*")), F.lit("")),
    )
    by = rows.select("doc_id", "_n", F.struct("_k", item.alias("item")).alias("x")).groupBy("doc_id").agg(F.max("_n").alias("n"), F.array_sort(F.collect_list("x")).alias("xs"))
    head = F.concat(F.lit(f"# {title}\n\n"), F.col("n").cast("string"), F.lit(" findings"), F.when(F.col("n") > F.size("xs"), F.concat(F.lit(", "), F.size("xs").cast("string"), F.lit(" listed"))).otherwise(""))
    return by.select("doc_id", F.concat_ws("\n\n", head, F.array_join(F.transform("xs", lambda x: x["item"]), "\n\n")).alias("report"))


def write_markdown(findings: DataFrame, path: str, most: int = 100) -> None:
    """``markdown_report`` as one folder of text a document: ``path``/doc_id=<id>."""
    markdown_report(findings, most).write.mode("overwrite").partitionBy("doc_id").text(path)


def _image_header(data: bytes | None) -> dict:
    """Width, height, mode, format and whether there is a colour profile, from the head of a PNG, JPEG or GIF."""
    none = {"width": None, "height": None, "mode": None, "format": None, "has_icc": None}
    if data is None:
        return none
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 26:
        w, h, depth, colour = struct.unpack(">IIBB", data[16:26])
        modes = {0: "1" if depth == 1 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
        at, icc = 8, False
        while at + 8 <= len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            if name in (b"IDAT", b"IEND"):
                break
            icc |= name == b"iCCP"
            at += 12 + size
        return {"width": w, "height": h, "mode": modes.get(colour), "format": "PNG", "has_icc": icc}
    if data[:2] == b"\xff\xd8":
        at, icc = 2, False
        while at + 4 <= len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            icc |= mark == 0xE2 and data[at + 4 : at + 15] == b"ICC_PROFILE"
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and at + 10 <= len(data):
                h, w, parts = struct.unpack(">HHB", data[at + 5 : at + 10])
                return {"width": w, "height": h, "mode": {1: "L", 3: "RGB", 4: "CMYK"}.get(parts), "format": "JPEG", "has_icc": icc}
            at += 2 + size
        return none
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        w, h = struct.unpack("<HH", data[6:10])
        return {"width": w, "height": h, "mode": "P", "format": "GIF", "has_icc": False}
    return none


#: Bytes of a file that are looked at for an image's header.
HEAD = 1 << 20


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, mode, format, has_icc) of PNG, JPEG and GIF files; nulls for others. Pixels are never decoded."""
    kind = "width int, height int, mode string, format string, has_icc boolean"

    @F.pandas_udf(kind)
    def header(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_image_header(None if c is None else bytes(c)) for c in content], columns=["width", "height", "mode", "format", "has_icc"])

    raw = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, HEAD).alias("content"))
    return raw.select("path", header("content").alias("h")).select("path", "h.*")


_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n", re.S)
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_BOX = re.compile(rb"/MediaBox\s*\[\s*([^\]]+?)\s*\]")


def _pdf_parts(data: bytes) -> list[bytes]:
    """A file's bytes, and its compressed objects unpacked (plain ones are seen anyway); raises where those can't be."""
    parts = [data]
    for m in _STREAM.finditer(data):
        if re.search(rb"/Type\s*/ObjStm", m[1]):
            if b"/FlateDecode" in m[1] and b"/DecodeParms" not in m[1]:
                parts.append(zlib.decompressobj().decompress(data[m.end() :]))
            elif b"/Filter" in m[1]:
                raise ValueError("objects are packed in another way")
    return parts


def _pdf(data: bytes | None) -> dict:
    none = {"pages": None, "boxes": None}
    if data is None or data[:4] != b"%PDF":
        return none
    try:
        parts = _pdf_parts(data)
        if len(parts) > 1 and b"/Encrypt" in data:
            return none
    except (ValueError, zlib.error):
        return none
    pages = sum(len(_PAGE.findall(p)) for p in parts)
    boxes = set()
    for box in (b for p in parts for b in _BOX.findall(p)):
        try:
            boxes.add(tuple(float(x) for x in box.split()))
        except ValueError:
            continue
    return {"pages": max(1, pages), "boxes": [list(b) for b in sorted(boxes)]}


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, pages, boxes) of PDF files: the number of page objects, one at least, and the distinct media boxes in points.

    Compressed objects are unpacked. Both are null where that can't be done (another
    compression, encrypted or damaged ones); files that aren't PDF are left out.
    """

    @F.pandas_udf("pages int, boxes array<array<double>>")
    def parts(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_pdf(None if c is None else bytes(c)) for c in content], columns=["pages", "boxes"]).astype({"pages": "Int32"})

    raw = spark.read.format("binaryFile").load(path).where(F.substring("content", 1, 4) == F.lit(b"%PDF"))
    return raw.select("path", parts("content").alias("p")).select("path", "p.pages", "p.boxes")
