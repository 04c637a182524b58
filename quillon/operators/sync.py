"""Knowledge files to knowledge tables, in one commit.

Files (YAML, of which JSON is a part) are read and parsed on the executors, one
row an entity, predicate, relationship or claim. A contract is checked over all
rows, names are resolved and claims are held against their predicates' rules as
joins; only if nothing is wrong are the tables of a ``Store`` changed, all at
once: entities and predicates by key, everything else by replacing what came from
the same files. A file can be synced again and again.

Tables: ``entities`` (uid, name, type, description, universe_uid, authority),
``aliases`` (uid, alias, source), ``predicates`` (code, label, description,
value_kind, cardinality, temporal_mode, unit, entity_ok, literal_ok),
``relationships`` (a, b, type, from_scene, notes, source), ``states`` (uid, scene,
attribute, value, source), ``claims`` (source, at, subject, predicate, object,
value, scene, valid_from, valid_to, confidence, excerpt, authority), ``mentions``
(uid, scene, start, end, source), ``runs`` (source, sha256, run, entities, claims).

Defined results: files without a map as their root, or that can't be parsed, are
issues; a null or empty text is no name; names are compared in lower case, those
of the same file before those of other files before those that are known, of
equal ones the smallest uid; of entities that share a uid the last by file and
place counts; a file without knowledge clears what it had brought before (one without
any bytes isn't listed by Spark's reader).

A file's bytes come to a task in pieces. Up to ``WHOLE`` of them are held in memory,
more on the task's disk, from where JSON is read a window at a time; YAML that isn't
JSON is held whole.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import hashing as H
from quillon.operators.knowledge import mentions, typed_claims
from quillon.operators.relational import insert_ignore, upsert
from quillon.session import Rounds, tasks_for
from quillon.sources.lease import Lease
from quillon.sources.versions import Store

#: Fixed values of the contract.
ENTITY_TYPES = ("character", "location", "organization", "object", "concept")
VALUE_KINDS = ("any", "text", "number", "boolean", "entity", "date")
CARDINALITIES = ("single", "multiple")
TEMPORAL_MODES = ("timeless", "point", "interval")
COLLECTIONS = ("entities", "predicates", "relationships", "claims")
VERSION = 1
#: Items of a file that are handed on at once.
TOGETHER = 5000
#: Bytes of a file that a task holds in memory, and of a larger one that it reads from its disk at once.
WHOLE, WINDOW = 4 << 20, 1 << 20
#: Bytes of a file that are sent to its task as one row, about, and bytes of files for a task.
PIECE, TASK = 1 << 12, 16 << 20
_JSON, _SPACE, _BOM = json.JSONDecoder(), re.compile(r"[ \t\n\r]*"), codecs.BOM_UTF8

TABLES = {
    "entities": "uid string, name string, type string, description string, universe_uid string, authority string",
    "aliases": "uid string, alias string, source string",
    "predicates": "code string, label string, description string, value_kind string, cardinality string, temporal_mode string, unit string, entity_ok boolean, literal_ok boolean",
    "relationships": "a string, b string, type string, from_scene string, notes string, source string",
    "states": "uid string, scene string, attribute string, value string, source string",
    "claims": "source string, at int, subject string, predicate string, object string, value string, scene string, valid_from string, valid_to string, confidence double, excerpt string, authority string",
    "mentions": "uid string, scene string, start int, end int, source string",
    "runs": "source string, sha256 string, run int, entities long, claims long",
}


class ContractError(ValueError):
    """What is wrong, as (source, path, message)."""

    def __init__(self, issues: list[tuple[str, str, str]], n: int):
        self.issues, self.n = issues, n
        super().__init__(f"{n} issues: " + "; ".join(f"{s} {p}: {m}" for s, p, m in issues))


@dataclass
class _At:
    """Where a list begins in a text, and in its file's bytes."""

    at: int
    byte: int


class _Text:
    """A text, or the text of a file, of which a window is held: what lies before the place asked for last is let go."""

    def __init__(self, text: str = "", file: BinaryIO | None = None, start: int = 0):
        self.held, self.file, self.start = text, file, start
        self.back(_At(0, start))

    def back(self, to: _At) -> None:
        self.base, self.byte = 0, self.start
        if self.file:
            self.base, self.byte, self.held, self.decoder = to.at, to.byte, "", codecs.getincrementaldecoder("utf-8")()
            self.file.seek(to.byte)

    def whole(self) -> str:
        if not self.file:
            return self.held
        self.file.seek(self.start)
        return self.file.read().decode()

    def _more(self, n: int) -> bool:
        data = self.file.read(n) if self.file else b""
        if data:
            self.held += self.decoder.decode(data)
        return bool(data)

    def _place(self, at: int) -> int:
        """Where ``at`` is in what is held."""
        while at - self.base >= len(self.held) and self._more(WINDOW):
            pass
        if self.file and at - self.base > WINDOW:
            gone = at - self.base
            self.byte += len(self.held[:gone].encode())
            self.held, self.base = self.held[gone:], at
        return at - self.base

    def mark(self, at: int) -> _At:
        k = self._place(at)
        return _At(at, self.byte + len(self.held[:k].encode()) if self.file else 0)

    def char(self, at: int) -> str:
        k = self._place(at)
        return self.held[k:k + 1]

    def space(self, at: int) -> int:
        """The first place from ``at`` on that isn't white space."""
        while True:
            k = self._place(at)
            k = _SPACE.match(self.held, k).end()
            at = self.base + k
            if k < len(self.held) or not self._more(WINDOW):
                return at

    def value(self, at: int) -> tuple[object, int]:
        """The JSON value at a place, and the place behind it."""
        k, n = self._place(at), WINDOW
        while True:
            try:
                value, end = _JSON.raw_decode(self.held, k)
                # A number can go on behind what is held, and 1e+ is 1 without it.
                if len(self.held) - end > 2 or not self._more(n):
                    return value, self.base + end
            except ValueError:
                if not self._more(n):
                    raise
            n *= 2


def _entries(text: _Text, at: int, close: str) -> Iterator[tuple[str | None, int]]:
    """(key, place of the value) of a JSON map or list that opens before ``at``; the caller sends back where the value ends."""
    at = text.space(at)
    if text.char(at) == close:
        return
    while True:
        key = None
        if close == "}":
            if text.char(at) != '"':
                raise ValueError("a key is needed")
            key, at = text.value(at)
            at = text.space(at)
            if text.char(at) != ":":
                raise ValueError("a colon is needed")
            at = text.space(at + 1)
        at = yield key, at
        at = text.space(at)
        if text.char(at) == close:
            return
        if text.char(at) != ",":
            raise ValueError("a comma is needed")
        at = text.space(at + 1)


def _list(text: _Text, at: int) -> Iterator[tuple[object, int]]:
    """Items of the JSON list that begins at ``at``, one at a time, each with the place behind it."""
    steps = _entries(text, at + 1, "]")
    try:
        _, at = next(steps)
        while True:
            item, end = text.value(at)
            yield item, end
            _, at = steps.send(end)
    except StopIteration:
        return


def _again(text: _Text, place: _At) -> Iterator[object]:
    text.back(place)
    for item, _ in _list(text, place.at):
        yield item


def _places(text: _Text) -> dict[str, int | object] | None:
    """The fields of a JSON map: collections as the place of their list, others as values. None: it isn't plain JSON."""
    found = {}
    try:
        start = text.space(0)
        if text.char(start) != "{":
            return None
        steps = _entries(text, start + 1, "}")
        end = start + 1
        try:
            key, at = next(steps)
            while True:
                if key in COLLECTIONS and text.char(at) == "[":
                    place, end = text.mark(at), at + 1
                    for _, end in _list(text, at):
                        pass
                    found[key], end = place, text.space(end) + 1
                else:
                    found[key], end = text.value(at)
                key, at = steps.send(end)
        except StopIteration:
            pass
        last = text.space(end)
        whole = text.char(last) == "}" and text.char(text.space(last + 1)) == ""
    except Exception:
        return None
    return found if whole else None


def _rows(text: str | _Text) -> Iterator[tuple[str, int, str]]:
    """(kind, place, item) of a file; what has no place in a table is an issue. Of JSON, one item at a time is held as objects."""
    text = text if isinstance(text, _Text) else _Text(text)
    root = _places(text)
    try:
        if root is None:
            whole = text.whole()
            try:
                root = json.loads(whole)
            except ValueError:
                import yaml

                root = yaml.safe_load(whole)
    except Exception as err:
        yield "issue", 0, json.dumps({"path": "$", "message": f"can't be parsed: {str(err).splitlines()[0][:200]}"})
        return
    root = {} if root is None else root
    bad = lambda path, message: ("issue", 0, json.dumps({"path": path, "message": message}))
    if not isinstance(root, dict):
        yield bad("$", "the root must be a map")
        return
    if root.get("schema_version") not in (None, VERSION):
        yield bad("schema_version", f"must be {VERSION}")
    if root.get("schema_version") is None and "entities" not in root:
        # Older dossiers: people with a name, a part, and whatever else is known of them.
        if root and not isinstance(root.get("personagens"), list):
            yield bad("$", "there are neither entities nor schema_version")
        people = [p for p in root.get("personagens") or [] if isinstance(p, dict) and p.get("nome")]
        root = root | {"entities": [{"name": p["nome"], "type": "character", "description": p.get("papel")} for p in people]}
    for kind in COLLECTIONS:
        items = root.get(kind) or []
        if isinstance(items, _At):
            items = _again(text, items)
        elif not isinstance(items, list):
            yield bad(kind, "must be a list")
            continue
        for k, item in enumerate(items):
            if isinstance(item, dict):
                yield kind, k, json.dumps(item, ensure_ascii=False, default=str)
            else:
                yield bad(f"{kind}[{k}]", "must be a map")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of files, as they follow each other, in rows of about ``PIECE`` bytes, numbered."""
    n, key, held, size = 0, None, [], 0
    for batch in batches:
        out = []
        for path, block, data in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "data")), strict=True):
            if held and (size >= PIECE or key != (path, block)):
                out.append((*key, n, b"".join(held)))
                n, held, size = n + 1, [], 0
            key = path, block
            held += data, _END
            size += len(data) + 1
        if out:
            yield _packed(out)
    if held:
        yield _packed([(*key, n, b"".join(held))])


#: Where Spark's reader cuts a file; it isn't part of any other character in UTF-8, and few items are without one.
_END = b"}"


def _packed(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    path, block, at, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path), pa.array(block, pa.int64()), pa.array(at, pa.int64()), pa.array(data, pa.binary())], ["path", "block", "at", "data"])


def _found(source: str, size: int, file: BinaryIO) -> Iterator[pa.RecordBatch]:
    """The rows of a file of ``size`` bytes, of which ``file`` has those that Spark's reader gave, behind a byte-order mark."""
    got = file.tell() - len(_BOM)
    # The reader leaves out a byte-order mark, and doesn't tell whether a file ends with the character where it cuts.
    more = size - got
    start = 0 if more in (2, 3) else len(_BOM)
    if more in (-1, 2):
        file.seek(-1, 2)
        file.truncate()
    file.seek(start)
    sha, utf8, good = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")(), more in (-1, 0, 2, 3)
    while data := file.read(WINDOW):
        sha.update(data)
        try:
            good = good and utf8.decode(data) is not None
        except UnicodeDecodeError:
            good = False
    if good and not utf8.getstate()[0]:
        text = _Text(file=file, start=start)
        rows = _rows(text.whole() if size <= WHOLE else text)
    else:
        rows = iter([("issue", 0, json.dumps({"path": "$", "message": "isn't UTF-8"}))])
    rows = chain([("file", 0, "{}")], rows)
    while part := list(islice(rows, TOGETHER)):
        kinds, places, items = zip(*part, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([source] * len(part)), pa.array([sha.hexdigest()] * len(part)), pa.array(kinds), pa.array(places, pa.int32()), pa.array(items)], ["source", "sha256", "kind", "at", "item"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files, each a row with its name and size and then its pieces."""
    now, file = None, None
    for batch in batches:
        for k in range(len(batch)):
            path, source, size, data = (batch.column(c)[k].as_py() for c in ("path", "source", "size", "data"))
            if data is None:
                if file:
                    yield from _found(*now[1:], file)
                    file.close()
                now, file = (path, source, size), tempfile.SpooledTemporaryFile(WHOLE)
                file.write(_BOM)
            elif now and now[0] == path:
                file.write(data)
    if file:
        yield from _found(*now[1:], file)
        file.close()


def items(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """(source, sha256, kind, at, item as JSON text) of the files that ``path`` names; every file has a row of kind "file".

    ``name``: what a file is called, from its ``path``; the last part of it by default.
    """
    name = F.element_at(F.split("path", "/"), -1) if name is None else name
    file, none = F.col("_metadata.file_path").alias("path"), F.lit(None).cast("binary").alias("data")
    heads = spark.read.format("binaryFile").load(path).select(file, name.alias("source"), F.col("length").alias("size"), F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("at"), none)
    cut = spark.read.option("lineSep", _END.decode()).text(path).select(file, F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))
    pieces = cut.mapInArrow(_pack, "path string, block long, at long, data binary")
    tasks = tasks_for(spark, heads.agg(F.sum("size")).first()[0] or 0, TASK)
    dealt = heads.unionByName(pieces, allowMissingColumns=True).repartition(tasks, "path").sortWithinPartitions("path", "block", "at")
    return dealt.mapInArrow(_parse, "source string, sha256 string, kind string, at int, item string")


def _text(path: str) -> Column:
    return F.expr(f"try_variant_get(v, '$.{path}', 'string')")


def _kind(path: str) -> Column:
    """JSON type of a field; null where it isn't there, or null."""
    return F.nullif(F.schema_of_variant(F.expr(f"try_variant_get(v, '$.{path}', 'variant')")), F.lit("VOID"))


def _of(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind).withColumn("v", F.try_parse_json("item"))


def contract_issues(rows: DataFrame) -> DataFrame:
    """(source, path, message) of everything in ``items`` that breaks the contract."""
    out = _of(rows, "issue").select("source", _text("path").alias("path"), _text("message").alias("message"))

    def check(kind: str, rules: list[tuple[str, Column, str]]) -> None:
        nonlocal out
        found = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(field).alias("f"), F.lit(message).alias("m"))) for field, broken, message in rules]), lambda x: x.isNotNull())
        hit = of[kind].select("source", "at", F.explode(found).alias("x"))
        out = out.unionByName(hit.select("source", F.concat(F.lit(f"{kind}["), F.col("at").cast("string"), F.lit("]"), F.when(F.col("x.f") != "", F.concat(F.lit("."), "x.f")).otherwise("")).alias("path"), F.col("x.m").alias("message")))

    of = {kind: _of(rows, kind) for kind in COLLECTIONS}
    again = F.row_number().over(W.partitionBy("source", F.lower(_text("name"))).orderBy("at")) > 1
    of["entities"] = of["entities"].withColumn("again", _text("name").isNotNull() & again)
    no_text = lambda f: (_kind(f) != "STRING") | _kind(f).isNull() | (F.trim(_text(f)) == "")
    missing = lambda f: _text(f).isNull() | (_text(f) == "")
    check("entities", [
        ("name", no_text("name"), "a text is needed"), ("name", F.col("again"), "the name comes twice in the file"),
        ("type", ~F.coalesce(_text("type"), F.lit("concept")).isin(*ENTITY_TYPES), "unknown type"),
        ("aliases", _kind("aliases").isNotNull() & ~_kind("aliases").isin("ARRAY<STRING>", "ARRAY<VOID>"), "must be a list of texts"),
        ("state_scene_uid", _kind("attributes").isNotNull() & (_kind("attributes") != "OBJECT<>") & missing("state_scene_uid"), "is needed with attributes"),
    ])
    check("predicates", [
        ("code", missing("code"), "is needed"), ("value_kind", ~F.coalesce(_text("value_kind"), F.lit("any")).isin(*VALUE_KINDS), "unknown kind of value"),
        ("cardinality", ~F.coalesce(_text("cardinality"), F.lit("multiple")).isin(*CARDINALITIES), "must be single or multiple"),
        ("temporal_mode", ~F.coalesce(_text("temporal_mode"), F.lit("timeless")).isin(*TEMPORAL_MODES), "unknown mode"),
    ])
    check("relationships", [(f, missing(f), "is needed") for f in ("source", "target")])
    has_value = F.get_json_object("item", "$.value").isNotNull() | F.col("item").rlike(r'(?s)^\{(?:.*[,{])?\s*"value"\s*:')
    check("claims", [(f, missing(f), "is needed") for f in ("subject", "predicate", "scene_uid")] + [
        ("", _text("object_entity").isNotNull() == has_value, "give either object_entity or value"),
        ("valid_from_scene_uid", ~missing("valid_to_scene_uid") & missing("valid_from_scene_uid"), "is needed with valid_to_scene_uid"),
    ])
    return out


def create(spark: SparkSession, root: str) -> Store:
    """An empty set of tables."""
    store = Store(spark, root)
    store.commit(replace={n: spark.createDataFrame([], s) for n, s in TABLES.items()}, expected=0, meta={"run": 0})
    return store


def _refuse(issues: DataFrame, listed: int = 20) -> None:
    n = issues.count()
    if n:
        raise ContractError([tuple(r) for r in issues.orderBy("source", "path", "message").limit(listed).collect()], n)


def sync(store: Store, files: DataFrame, scenes: DataFrame, work: str, authority: str = "editorial_dossier", namespace: str = uuid.NAMESPACE_URL.hex, extract_mentions: bool = True, lease: Lease | None = None, between=None) -> int:
    """Bring ``items`` into the tables of ``store``; the new version is the result, a ``ContractError`` leaves all as it was.

    ``scenes`` (scene, content, active): what places and mentions refer to; ``work``
    and ``namespace`` make the uids of entities that name none.
    """
    spark = store.spark
    rounds = Rounds(spark, "sync")
    rows = rounds.put(files)
    _refuse(contract_issues(rows))
    expected = store.version()
    old = {n: store.read(n, expected) for n in TABLES}
    run = store.meta(expected)["run"] + 1
    sources = rows.where("kind = 'file'").select("source", "sha256").distinct()
    kept = {n: old[n].join(F.broadcast(sources.select("source")) if sources.count() <= 10_000 else sources.select("source"), "source", "left_anti").select(old[n].columns) for n in ("aliases", "relationships", "states", "claims", "mentions")}

    e = _of(rows, "entities")
    uid = F.coalesce(F.nullif(_text("uid"), F.lit("")), H.uuid5(namespace, F.concat_ws(":", F.lit(work), F.coalesce(_text("type"), F.lit("concept")), _text("name"))))
    given = rounds.put(e.select("source", "at", uid.alias("uid"), _text("name").alias("name"), F.coalesce(_text("type"), F.lit("concept")).alias("type"), _text("description").alias("description"), _text("universe_uid").alias("universe_uid"), F.lit(authority).alias("authority"), "v"))
    last = given.groupBy("uid").agg(F.max_by(F.struct("name", "type", "description", "universe_uid", "authority"), F.struct("source", "at")).alias("x")).select("uid", "x.*")
    before = old["entities"].select("uid", F.col("type").alias("t0"), F.col("description").alias("d0"), F.col("universe_uid").alias("u0"))
    # A known entity keeps its type, and what the file doesn't say.
    merged = last.join(before, "uid", "left").select("uid", "name", F.coalesce("t0", "type").alias("type"), F.coalesce("description", "d0").alias("description"), F.coalesce("universe_uid", "u0").alias("universe_uid"), "authority")
    entities = rounds.put(upsert(old["entities"], merged, ["uid"]))

    listed = given.select("uid", F.explode(F.expr("try_variant_get(v, '$.aliases', 'array<string>')")).alias("alias"), "source").where("alias <> ''")
    aliases = rounds.put(insert_ignore(kept["aliases"], listed.groupBy("uid", "alias").agg(F.min("source").alias("source")), ["uid", "alias"]).select(old["aliases"].columns))

    p = _of(rows, "predicates")
    title = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    flag = lambda f: F.coalesce(F.expr(f"try_variant_get(v, '$.{f}', 'boolean')"), F.lit(True))
    rule = F.struct(
        F.coalesce(_text("label"), title(_text("code"))).alias("label"), _text("description").alias("description"), F.coalesce(_text("value_kind"), F.lit("any")).alias("value_kind"), F.coalesce(_text("cardinality"), F.lit("multiple")).alias("cardinality"),
        F.coalesce(_text("temporal_mode"), F.lit("timeless")).alias("temporal_mode"), _text("unit").alias("unit"), flag("allows_entity_object").alias("entity_ok"), flag("allows_literal_object").alias("literal_ok"),
    )
    stated = p.groupBy(_text("code").alias("code")).agg(F.max_by(rule, F.struct("source", "at")).alias("x")).select("code", "x.*")
    c = _of(rows, "claims")
    # A claim may name a predicate that has no rule: any value will do.
    named = c.select(_text("predicate").alias("code")).distinct().select("code", title(F.col("code")).alias("label"), *[F.lit(None).cast("string").alias(n) for n in ("description", "value_kind", "cardinality", "temporal_mode", "unit")], F.lit(True).alias("entity_ok"), F.lit(True).alias("literal_ok"))
    predicates = rounds.put(insert_ignore(upsert(old["predicates"], stated, ["code"]), named, ["code"]))

    name_of = lambda df, *by: df.groupBy(*by, F.lower("name").alias("key")).agg(F.min("uid").alias("uid"))
    own, others, known = name_of(given, "source"), name_of(given), name_of(old["entities"])

    def resolved(df: DataFrame, col: str, to: str) -> DataFrame:
        # Rows without a name, often all of them, mustn't meet in one task: each has a key of its own.
        df = df.withColumn("key", F.coalesce(F.lower(col), F.concat_ws("\0", F.lit(""), "source", F.col("at").cast("string"))))
        for k, names in enumerate((own, others, known)):
            df = df.join(names.withColumnRenamed("uid", f"_{k}"), ["source", "key"] if k == 0 else "key", "left")
        return df.withColumn(to, F.when(F.col(col).isNotNull(), F.coalesce("_0", "_1", "_2"))).drop("_0", "_1", "_2", "key")

    r = _of(rows, "relationships").select("source", "at", _text("source").alias("a_name"), _text("target").alias("b_name"), F.coalesce(_text("type"), F.lit("related_to")).alias("type"), F.nullif(_text("from_scene_uid"), F.lit("")).alias("from_scene"), _text("notes").alias("notes"))
    r = rounds.put(resolved(resolved(r, "a_name", "a"), "b_name", "b"))
    said = c.select(
        "source", "at", _text("subject").alias("subject_name"), _text("predicate").alias("predicate"), _text("object_entity").alias("object_name"), F.when(_text("object_entity").isNull(), F.coalesce(F.expr("to_json(try_variant_get(v, '$.value', 'variant'))"), F.lit("null"))).alias("value"),
        _text("scene_uid").alias("scene"), F.nullif(_text("valid_from_scene_uid"), F.lit("")).alias("valid_from"), F.nullif(_text("valid_to_scene_uid"), F.lit("")).alias("valid_to"), F.coalesce(F.expr("try_variant_get(v, '$.confidence', 'double')"), F.lit(1.0)).alias("confidence"), _text("excerpt").alias("excerpt"),
    )
    said = rounds.put(resolved(resolved(said, "subject_name", "subject"), "object_name", "object"))
    s = given.select("source", "at", "uid", _text("state_scene_uid").alias("scene"), F.explode(F.expr("try_variant_get(v, '$.attributes', 'map<string, variant>')")).alias("attribute", "value")).where("scene IS NOT NULL AND scene <> ''")
    states = rounds.put(s.groupBy("uid", "scene", "attribute").agg(F.max_by(F.struct(F.to_json("value").alias("value"), "source"), F.struct("source", "at")).alias("x")).select("uid", "scene", "attribute", "x.value", "x.source"))

    # What the rows refer to must be there.
    issue = lambda df, kind, field, name, message: df.select("source", F.concat(F.lit(f"{kind}["), F.col("at").cast("string"), F.lit(f"].{field}")).alias("path"), F.concat(F.lit(f"{message}: "), F.col(name)).alias("message"))
    places = scenes.select(F.col("scene").alias("_scene")).distinct()
    lost = lambda df, col: df.where(F.col(col).isNotNull()).join(places, F.col(col) == F.col("_scene"), "left_anti")
    wrong = issue(r.where("a IS NULL"), "relationships", "source", "a_name", "unknown entity").unionByName(issue(r.where("b IS NULL"), "relationships", "target", "b_name", "unknown entity"))
    wrong = wrong.unionByName(issue(lost(r, "from_scene"), "relationships", "from_scene_uid", "from_scene", "unknown scene"))
    wrong = wrong.unionByName(issue(said.where("subject IS NULL"), "claims", "subject", "subject_name", "unknown entity")).unionByName(issue(said.where("object IS NULL AND object_name IS NOT NULL"), "claims", "object_entity", "object_name", "unknown entity"))
    for col, field in (("scene", "scene_uid"), ("valid_from", "valid_from_scene_uid"), ("valid_to", "valid_to_scene_uid")):
        wrong = wrong.unionByName(issue(lost(said, col), "claims", field, col, "unknown scene"))
    held = given.where("v IS NOT NULL").select("source", "at", _text("state_scene_uid").alias("scene")).where("scene <> ''")
    wrong = wrong.unionByName(issue(lost(held, "scene"), "entities", "state_scene_uid", "scene", "unknown scene"))
    rules = predicates.select(F.col("code").alias("predicate"), F.when(F.col("value_kind") == "date", "text").otherwise(F.col("value_kind")).alias("value_kind"))
    typed = typed_claims(said.select(F.struct("source", "at").alias("id"), "predicate", "value", F.col("object_name").alias("object_entity")), rules)
    wrong = wrong.unionByName(typed.where("issue = 'wrong_type'").select("id.source", F.concat(F.lit("claims["), F.col("id.at").cast("string"), F.lit("]")).alias("path"), F.lit("the value isn't of the predicate's kind").alias("message")))
    limits = said.join(predicates.select(F.col("code").alias("predicate"), "entity_ok", "literal_ok"), "predicate").where("(object_name IS NOT NULL AND NOT entity_ok) OR (object_name IS NULL AND NOT literal_ok)")
    _refuse(wrong.unionByName(issue(limits, "claims", "predicate", "predicate", "doesn't take such an object")))

    met = r.groupBy("a", "b", "type", "from_scene").agg(F.min_by(F.struct("notes", "source"), F.struct("source", "at")).alias("x")).select("a", "b", "type", "from_scene", "x.*")
    there = kept["relationships"].select("a", "b", "type", "from_scene").distinct()
    new = met.alias("m").join(there.alias("t"), (F.col("m.a") == F.col("t.a")) & (F.col("m.b") == F.col("t.b")) & (F.col("m.type") == F.col("t.type")) & F.col("m.from_scene").eqNullSafe(F.col("t.from_scene")), "left_anti")
    replace = {
        "entities": entities, "aliases": aliases, "predicates": predicates, "relationships": kept["relationships"].unionByName(new),
        "states": upsert(kept["states"], states, ["uid", "scene", "attribute"]), "claims": kept["claims"].unionByName(said.withColumn("authority", F.lit(authority)).select(old["claims"].columns)),
    }
    if extract_mentions:
        names = entities.select("uid", F.col("name").alias("alias")).unionByName(aliases.select("uid", "alias")).withColumnRenamed("uid", "entity")
        found = mentions(scenes.where("active"), names, "scene", "content").select(F.col("entity").alias("uid"), F.col("id").alias("scene"), "start", "end").distinct()
        # They belong to this run's files; with several, to the first.
        first = sources.agg(F.min("source").alias("source"))
        replace["mentions"] = insert_ignore(kept["mentions"], found.crossJoin(F.broadcast(first)), ["uid", "scene", "start", "end"]).select(old["mentions"].columns)
    else:
        replace["mentions"] = kept["mentions"]
    n = rows.groupBy("source").agg(F.count_if(F.col("kind") == "entities").alias("entities"), F.count_if(F.col("kind") == "claims").alias("claims"))
    runs = sources.join(n, "source").select("source", "sha256", F.lit(run).alias("run"), "entities", "claims")
    version = store.commit(replace=replace, append={"runs": runs}, meta={"run": run}, expected=expected, lease=lease, between=between)
    rounds.last(sources)
    return version
