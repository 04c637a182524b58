"""Entities and claims: lookup, identity, mentions, dossiers, continuity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import hashing as H
from quillon.operators.automaton import occurrences
from quillon.operators.graph import PEEL, strong_components
from quillon.operators.intervals import partners
from quillon.session import settled


def lookup(wanted: DataFrame, maps: list[DataFrame], redirects: DataFrame | None = None, collation: str | None = None) -> DataFrame:
    """(key, id) for each wanted key, from the first map (key, id) that has it; ties take the smallest id.

    ``redirects`` (source, target) send a found id on, one hop. With a ``collation``
    (``text.ANY_CASE``: case and marks of any script are ignored) keys are equal as it says; a wanted key comes back as it was asked for.
    """
    ranked = reduce(DataFrame.unionByName, [m.select("key", "id", F.lit(p).alias("pref")) for p, m in enumerate(maps)])
    asked = wanted.select("key").distinct()
    if collation is None:
        best = ranked.join(asked, "key", "left_semi").groupBy("key").agg(F.min(F.struct("pref", "id")).alias("b"))
    else:
        same = F.collate("key", collation).alias("same")
        best = asked.select("key", same).join(ranked.select(same, "pref", "id").groupBy("same").agg(F.min(F.struct("pref", "id")).alias("b")), "same")
    best = best.select("key", F.col("b.id").alias("id"))
    if redirects is not None:
        best = best.join(redirects, best["id"] == redirects["source"], "left").select("key", F.coalesce("target", "id").alias("id"))
    return best


def match_identity(local: DataFrame, shared: DataFrame, collation: str | None = None) -> DataFrame:
    """(id, eid, confidence): local (id, uid, name) against shared (eid, uid, name). Equal uid is certain
    (1.0), else an equal name, by ``collation`` if one is given, is a guess (0.5). Two equi-joins, not one with OR."""
    named = lambda df: df if collation is None else df.withColumn("name", F.collate("name", collation))
    by_uid = shared.where(F.col("uid").isNotNull()).select("uid", F.col("eid").alias("e1"))
    by_name = named(shared.select("name", F.col("eid").alias("e2")))
    out = named(local).join(by_uid, "uid", "left").join(by_name, "name", "left")
    conf = F.when(F.col("e1").isNotNull(), 1.0).when(F.col("e2").isNotNull(), 0.5)
    return out.select("id", F.coalesce("e1", "e2").alias("eid"), conf.alias("confidence"))


def repoint(edges: DataFrame, merged: DataFrame, ends: list[str]) -> DataFrame:
    """Edges with merged ids (source, target) replaced at both ends, repeated edges and self-edges dropped."""
    out = edges
    for end in ends:
        m = merged.select(F.col("source").alias(end), F.col("target").alias("_to"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out.select(*edges.columns).where(F.col(ends[0]) != F.col(ends[1])).distinct()


def split_entity(aliases: DataFrame, names: list[str], source: object, new: object) -> DataFrame:
    """(entity, alias) with the named aliases of one entity moved to a new one."""
    moved = (F.col("entity") == F.lit(source)) & F.lower("alias").isin([n.lower() for n in names])
    return aliases.withColumn("entity", F.when(moved, F.lit(new)).otherwise(F.col("entity")))


def mentions(texts: DataFrame, aliases: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, entity, start, end) of every whole-word occurrence of an alias (entity, alias), ignoring case.

    Occurrences of one alias don't overlap; those of different ones may. Positions
    are in characters. One pass a text finds all aliases (see ``automaton``); their
    entities are joined to the hits, so an alias of many entities costs one search.
    """
    alias = aliases.select("entity", F.lower("alias").alias("alias")).where("alias <> ''").distinct()
    return occurrences(texts, alias, id_col, text_col).join(alias, "alias").select("id", "entity", "start", "end")


def conflicts(claims: DataFrame) -> DataFrame:
    """Claims (id, subject, predicate, continuity, value, rank, starts, ends) that overlap in time with others of their subject, predicate and continuity that say something else, with how many (``partners``).

    A null continuity is "main". No pairs are listed: see ``intervals.partners``; for those, ``relational.overlapping_pairs``.
    """
    c = claims.select("id", "subject", "predicate", F.coalesce("continuity", F.lit("main")).alias("continuity"), "value", "rank", "starts", "ends")
    return partners(c, ["subject", "predicate", "continuity"], "id", "starts", "ends", "value")


def continuity(claims: DataFrame, ids: bool = True) -> DataFrame:
    """(subject, predicate, continuity, ids, severity): conflicts among claims, as ``conflicts`` finds them.

    If the best-ranked of the conflicting claims disagree among themselves it is an
    error, else a warning. ``ids`` lists all of them in one row; without it ``n``
    says how many they are, which suits subjects with very many claims.
    """
    by = ["subject", "predicate", "continuity"]
    ranked = conflicts(claims).groupBy(*by, "rank").agg(F.min("value").alias("low"), F.max("value").alias("high"), *([F.collect_set("id").alias("ids")] if ids else [F.count_distinct("id").alias("n")]))
    all_ = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids") if ids else F.sum("n").alias("n")
    out = ranked.groupBy(*by).agg(F.max_by(F.struct("low", "high"), "rank").alias("top"), all_)
    return out.select(*by, "ids" if ids else "n", F.when(F.col("top.low") != F.col("top.high"), "error").otherwise("warning").alias("severity"))


def conflict_classes(claims: DataFrame) -> DataFrame:
    """(subject, predicate, continuity, value, claims, links, first, last): what the conflicting claims of a subject say, how often, against how many others, and when."""
    by = ["subject", "predicate", "continuity", "value"]
    return conflicts(claims).groupBy(*by).agg(F.count(F.lit(1)).alias("claims"), F.sum("partners").alias("links"), F.min("starts").alias("first"), F.max("ends").alias("last"))


def reachable(edges: DataFrame, source: str, target: str, depth: int = 32) -> DataFrame:
    """(a, b) where b is reached from a in at most ``depth`` steps; a cycle shows as (a, a).

    Path doubling: ceil(log2(depth)) joins, each written. The result lists pairs, so
    it is meant for small graphs; for cycles in large ones see ``on_cycles``.
    """
    pairs = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).distinct()
    step = 1
    while step < depth:
        far = pairs.alias("x").join(pairs.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        pairs = settled(pairs.unionByName(far).distinct())
        step *= 2
    return pairs


def on_cycles(edges: DataFrame, source: str, target: str, rounds: int = PEEL) -> DataFrame:
    """(node): nodes on a cycle, of whatever length (see ``graph``); ``rounds``: peeling steps between other work."""
    return strong_components(edges, source, target, peel=rounds).select("node")


def universe_issues(claims: DataFrame, conflicts: DataFrame, precedence: DataFrame) -> DataFrame:
    """(code, severity, subject, predicate, continuity, ids) over a whole universe.

    universe_claim_conflict: a conflict (first, second, status) that is open.
    derived_universe_claim_conflict: claims (id, subject, predicate, value, continuity)
    of one subject, predicate and continuity with several values. timeline_cycle:
    events that precede themselves (earlier, later).
    """
    null = F.lit(None).cast("string")
    row = lambda df, code, severity, subject, predicate, branch, ids: df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), predicate.cast("string").alias("predicate"), branch.cast("string").alias("continuity"), ids.cast("array<long>").alias("ids"))
    open_ = row(conflicts.where("status = 'open'"), "universe_claim_conflict", "error", null, null, null, F.array("first", "second"))
    by = claims.withColumn("continuity", F.coalesce("continuity", F.lit("main"))).groupBy("subject", "predicate", "continuity")
    split = by.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.array_sort(F.collect_set("id")).alias("ids")).where("low <> high")
    derived = row(split, "derived_universe_claim_conflict", "error", F.col("subject"), F.col("predicate"), F.col("continuity"), F.col("ids"))
    cycle = row(on_cycles(precedence, "earlier", "later"), "timeline_cycle", "critical", null, null, null, F.array("node"))
    return open_.unionByName(derived).unionByName(cycle)


def state_at(events: DataFrame, entity: str, attribute: str, value: str, order: list[str], cutoff: tuple | None = None) -> DataFrame:
    """The state of each (entity, attribute) up to and with a position in the narrative order."""
    position = F.struct(*order)
    upto = events if cutoff is None else events.where(position <= F.struct(*[F.lit(c).cast(events.schema[o].dataType).alias(o) for o, c in zip(order, cutoff, strict=True)]))
    return upto.groupBy(entity, attribute).agg(F.max_by(value, position).alias(value))


def upto(rows: DataFrame, cutoff: tuple | None, document: str = "document", position: tuple[str, ...] = ("chapter", "scene")) -> DataFrame:
    """Rows of the cutoff's document at or before its place in the narrative: (document, chapter, scene). Without one, all rows."""
    if cutoff is None:
        return rows
    place = F.struct(*[F.lit(c).cast(rows.schema[p].dataType).alias(p) for p, c in zip(position, cutoff[1:], strict=True)])
    return rows.where((F.col(document) == F.lit(cutoff[0])) & (F.struct(*position) <= place))


def dossier(entity_rows: DataFrame, aliases: DataFrame, relations: DataFrame, mentions_: DataFrame, states: DataFrame | None = None, claims: DataFrame | None = None, cutoff: tuple | None = None) -> DataFrame:
    """One nested row an entity: (entity, name, aliases, relations, mentions), and with them timeline and claims.

    Each part is folded to a row an entity before it joins, so parts don't multiply.
    ``cutoff`` (document, chapter, scene) leaves out mentions and states that come
    later, for a reader who must not know them. states (entity, document, chapter,
    scene, ordinal, attribute, old, new): an event is a chapter, scene and ordinal with
    its deltas. claims (entity, predicate, value, continuity, rank): position is their
    place by rank among claims of one predicate and continuity.
    """
    al = aliases.groupBy("entity").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    out_ = relations.select(F.col("source").alias("entity"), F.struct(F.lit("out").alias("way"), "kind", F.col("target").alias("other")).alias("r"))
    in_ = relations.select(F.col("target").alias("entity"), F.struct(F.lit("in").alias("way"), "kind", F.col("source").alias("other")).alias("r"))
    rel = out_.unionByName(in_).groupBy("entity").agg(F.array_sort(F.collect_set("r")).alias("relations"))
    men = upto(mentions_, cutoff).groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))
    full = entity_rows.join(al, "entity", "left").join(rel, "entity", "left").join(men, "entity", "left")
    full = full.withColumn("mentions", F.coalesce("mentions", F.lit(0))).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    if states is not None:
        place = ["entity", "document", "chapter", "scene", "ordinal"]
        deltas = F.filter(F.array_sort(F.collect_list(F.struct("attribute", "old", "new"))), lambda d: d["attribute"].isNotNull())
        events = upto(states, cutoff).groupBy(*place).agg(deltas.alias("deltas"))
        full = full.join(events.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(*place[1:], "deltas"))).alias("timeline")), "entity", "left")
    if claims is not None:
        by = W.partitionBy("entity", "predicate", F.coalesce("continuity", F.lit("main"))).orderBy(F.desc_nulls_last("rank"))
        ranked = claims.withColumn("position", F.dense_rank().over(by))
        full = full.join(ranked.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("predicate", "continuity", "position", "value", "rank"))).alias("claims")), "entity", "left")
    return full


def scene_context(scenes: DataFrame, links: DataFrame, derivations: DataFrame) -> DataFrame:
    """``scenes`` (scene and what belongs to it) with links, array of (relationship, source, target, weight) that touch the scene, and derivations, kind to status.

    Links (relationship, source, target, weight) meet a scene at either end, each once;
    of repeated derivations (scene, kind, status) of a kind the largest status counts.
    """
    link = F.struct("relationship", "source", "target", "weight")
    ends = links.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("scene"), link.alias("l"))
    ends = ends.groupBy("scene").agg(F.array_sort(F.collect_set("l")).alias("links"))
    kinds = derivations.groupBy("scene", "kind").agg(F.max("status").alias("status"))
    kinds = kinds.groupBy("scene").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "status")))).alias("derivations"))
    out = scenes.join(ends, "scene", "left").join(kinds, "scene", "left")
    empty = F.array().cast(ends.schema["links"].dataType)
    return out.withColumns({"links": F.coalesce("links", empty), "derivations": F.coalesce("derivations", F.create_map().cast("map<string,string>"))})


#: How bad each broken invariant is.
INVARIANTS = {
    "table_integrity": "critical", "foreign_key": "critical", "source_missing": "error", "source_changed": "warning", "anchor_out_of_bounds": "error", "scene_hash_mismatch": "critical",
    "active_tombstone": "error", "passage_hash_mismatch": "critical", "inverted_claim_interval": "error", "missing_merkle_roots": "error", "stale_materializations": "warning", "governance_log_invalid": "critical",
}


def invariants(t: dict[str, DataFrame], keys: dict[str, str] | None = None, references: list[tuple[str, str, str, str]] | None = None, roots: int = 3) -> DataFrame:
    """(code, severity, owner): broken invariants of an index; tables that aren't given aren't checked.

    documents (document, sha), files (document, sha, n_lines), scenes (scene, document,
    start_line, end_line, content, sha), tombstones (scene, restored_at), passages
    (passage, content, sha), claims (claim, starts, ends: comparable positions),
    merkle_roots (document, kind), derivations (scene, kind, status), governance
    (chain, seq, payload, previous_hash, event_hash). ``keys``: table to its key, which
    must not repeat. ``references``: (table, column, table, key) that must resolve.
    """
    from quillon.operators.governance import verify_chain

    found: list[DataFrame] = []

    def add(code: str, rows: DataFrame, owner) -> None:
        found.append(rows.select(F.lit(code).alias("code"), F.lit(INVARIANTS[code]).alias("severity"), (owner if isinstance(owner, Column) else F.col(owner)).cast("string").alias("owner")))

    has = lambda *names: all(n in t for n in names)
    for name, key in (keys or {}).items():
        add("table_integrity", t[name].groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), F.concat_ws(":", F.lit(name), F.col(key).cast("string")))
    for child, column, parent, key in references or []:
        loose = t[child].where(F.col(column).isNotNull()).select(F.col(column).alias("_r")).join(t[parent].select(F.col(key).alias("_r")), "_r", "left_anti").distinct()
        add("foreign_key", loose, F.concat_ws(":", F.lit(f"{child}.{column}"), F.col("_r").cast("string")))
    if has("documents", "files"):
        files = t["files"].select("document", F.col("sha").alias("_sha"), "n_lines")
        add("source_missing", t["documents"].join(files, "document", "left_anti"), "document")
        add("source_changed", t["documents"].join(files, "document").where(F.col("sha").isNotNull() & (F.col("sha") != F.col("_sha"))), "document")
        if has("scenes"):
            add("anchor_out_of_bounds", t["scenes"].join(files, "document").where((F.col("start_line") < 1) | (F.col("end_line") > F.greatest("n_lines", F.lit(1)))), "scene")
    for name, code, key in (("scenes", "scene_hash_mismatch", "scene"), ("passages", "passage_hash_mismatch", "passage")):
        if has(name):
            add(code, t[name].where(F.sha2("content", 256) != F.col("sha")), key)
    if has("scenes", "tombstones"):
        add("active_tombstone", t["scenes"].join(t["tombstones"].where("restored_at IS NULL").select("scene").distinct(), "scene", "left_semi"), "scene")
    if has("claims"):
        add("inverted_claim_interval", t["claims"].where("starts > ends"), "claim")
    if has("documents", "merkle_roots"):
        full = t["merkle_roots"].groupBy("document").agg(F.count_distinct("kind").alias("n")).where(F.col("n") >= roots)
        add("missing_merkle_roots", t["documents"].join(full, "document", "left_anti"), "document")
    if has("derivations"):
        stale = t["derivations"].where("status IN ('stale', 'failed')").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        add("stale_materializations", stale, "n")
    if has("governance"):
        add("governance_log_invalid", verify_chain(t["governance"], "chain", "seq", "payload"), F.concat_ws(":", F.col("chain").cast("string"), F.col("seq").cast("string")))
    return reduce(DataFrame.unionByName, found)


def universe_sync(locals_: DataFrame, shared: DataFrame, namespace: str) -> DataFrame:
    """(work, local, entity, kind, confidence): each work's entities (work, local, type, name, uid, order) against the universe's (entity, type, name).

    A declared uid is a certain identity (1.0), else a uid is derived from type and
    name (0.5, uncertain). An entity with that uid is the one; else one of equal type
    and name, whatever the case; else a new one. New ones count for the entities that
    come later in ``order``, so the first work that brings a name settles it.
    """
    key = F.struct(F.col("type"), F.lower("name").alias("name"))
    own = locals_.withColumns({"global": F.coalesce("uid", H.uuid5(namespace, F.concat_ws(":", "type", F.lower("name")))), "key": key})
    known = shared.select(F.col("entity").alias("global"), F.col("entity").alias("by_uid"))
    named = shared.groupBy(key.alias("key")).agg(F.min("entity").alias("by_name"))
    rows = own.join(known, "global", "left").join(named, "key", "left").withColumn("found", F.coalesce("by_uid", "by_name"))
    # What isn't there yet: the first of a name brings its uid, and a uid that was brought before is found by itself.
    new = rows.where("found IS NULL")
    first = new.groupBy("key").agg(F.min_by("global", "order").alias("name_entity"))
    uids = new.join(first, "key").groupBy("global").agg(F.min_by("name_entity", "order").alias("uid_entity"), F.min("order").alias("uid_order"))
    new = rows.join(first, "key", "left").join(uids, "global", "left")
    entity = F.coalesce("found", F.when(F.col("uid_order") < F.col("order"), F.col("uid_entity")), "name_entity")
    sure = F.col("uid").isNotNull()
    return new.select("work", "local", entity.alias("entity"), F.when(sure, "same_identity").otherwise("uncertain").alias("kind"), F.when(sure, 1.0).otherwise(0.5).alias("confidence"))


def universe_relations(mapping: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations (work, source, target, type) of works between universe entities: (work, source, target, type, confidence); those with an unmapped end are left out."""
    end = lambda c: mapping.select("work", F.col("local").alias(c), F.col("entity").alias(f"_{c}"))
    return relations.join(end("source"), ["work", "source"]).join(end("target"), ["work", "target"]).select("work", F.col("_source").alias("source"), F.col("_target").alias("target"), "type", F.lit(1.0).alias("confidence"))


def next_free_ordinals(rows: DataFrame, keys: list[str], ordinal: str, ident: str) -> DataFrame:
    """Rows with colliding ordinals moved behind the largest one of their key; the smallest id keeps its place."""
    w = W.partitionBy(*keys, ordinal).orderBy(ident)
    ranked = rows.withColumn("_late", F.row_number().over(w) > 1)
    top = F.max(ordinal).over(W.partitionBy(*keys))
    late = F.sum(F.col("_late").cast("int")).over(W.partitionBy(*keys).orderBy(ordinal, ident).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranked.withColumn(ordinal, F.when(F.col("_late"), (top + late).cast(rows.schema[ordinal].dataType)).otherwise(F.col(ordinal))).drop("_late")


def typed_claims(claims: DataFrame, predicates: DataFrame) -> DataFrame:
    """Claims (id, predicate, value as JSON text, object_entity) that break their predicate's rule (predicate, value_kind): (id, issue).

    A claim has a value or an object entity, not both or neither; a value's JSON type
    must be the predicate's kind. An unknown predicate takes any value.
    """
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    fits = (
        F.when(F.coalesce("value_kind", F.lit("any")) == "any", True).when(F.col("value_kind") == "number", number).when(F.col("value_kind") == "boolean", kind == "BOOLEAN")
        .when(F.col("value_kind") == "entity", F.lit(False)).otherwise(kind == "STRING")
    )
    one = F.col("value").isNotNull() != F.col("object_entity").isNotNull()
    rules = [(~one, "not_exactly_one"), (F.col("value").isNotNull() & v.isNull(), "not_json"), (F.col("value").isNotNull() & v.isNotNull() & ~F.coalesce(fits, F.lit(False)), "wrong_type"),
             (F.col("object_entity").isNotNull() & ~F.coalesce("value_kind", F.lit("any")).isin("any", "entity"), "wrong_type")]
    rows = claims.join(predicates, "predicate", "left")
    return rows.select("id", F.explode(F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in rules]), lambda x: x.isNotNull())).alias("issue"))


def reconcile(documents: DataFrame, present: DataFrame) -> DataFrame:
    """(work, doc, available, active): documents (work, doc, role, active, updated) against the files there are (doc).

    A document whose file is gone is inactive. A work and role without an active
    document falls back to its latest available one.
    """
    rows = documents.join(present.select("doc", F.lit(True).alias("available")), "doc", "left").withColumn("available", F.coalesce("available", F.lit(False)))
    rows = rows.withColumn("active", F.col("active") & F.col("available"))
    has = rows.groupBy("work", "role").agg(F.bool_or("active").alias("any_active"), F.max(F.when(F.col("available"), F.struct("updated", "doc")))["doc"].alias("latest"))
    out = rows.join(has, ["work", "role"])
    return out.select("work", "doc", "available", (F.col("active") | (~F.col("any_active") & F.coalesce(F.col("doc") == F.col("latest"), F.lit(False)))).alias("active"))
