"""Knowledge files into tables: what a file says, what a second version changes, and what is refused."""

import json
import uuid

import pytest

from quillon.operators import sync as Y
from quillon.session import scratch
from quillon.sources.versions import Conflict

FIRST = """
schema_version: 1
entities:
  - {name: Ana Lima, type: character, aliases: [Aninha, Ana], attributes: {mood: calm, age: 30}, state_scene_uid: s1, description: a doctor}
  - {name: Porto, type: location, uid: place-1}
  - {name: Sino}
predicates:
  - {code: born_in, value_kind: entity, cardinality: single}
  - {code: age_of, value_kind: number, unit: year}
relationships:
  - {source: ana lima, target: Porto, type: lives_in, from_scene_uid: s2}
claims:
  - {subject: Ana Lima, predicate: born_in, object_entity: PORTO, scene_uid: s1}
  - {subject: Ana Lima, predicate: age_of, value: 30, scene_uid: s1, valid_from_scene_uid: s1, confidence: 0.5}
  - {subject: Sino, predicate: rings_at, value: null, scene_uid: s2}
"""
SCENES = [("s1", "Ana Lima chegou ao Porto. Aninha riu.", True), ("s2", "O sino tocou; ana dormia.", True), ("s3", "Ana e o Porto.", False)]


@pytest.fixture
def at(spark, tmp_path):
    scenes = spark.createDataFrame(SCENES, "scene string, content string, active boolean")
    store = Y.create(spark, scratch(spark, "knowledge"))

    def put(text, name="a.yaml", **how):
        (tmp_path / name).write_text(text)
        return Y.sync(store, Y.items(spark, str(tmp_path / name)), scenes, "work-1", **how)

    put.store = store
    put.read = lambda t: sorted(map(tuple, store.read(t).collect()), key=repr)
    return put


ANA = str(uuid.uuid5(uuid.NAMESPACE_URL, "work-1:character:Ana Lima"))
SINO = str(uuid.uuid5(uuid.NAMESPACE_URL, "work-1:concept:Sino"))


def test_first_and_second_version(at):
    at(FIRST)
    assert at.read("entities") == sorted([(ANA, "Ana Lima", "character", "a doctor", None, "editorial_dossier"), ("place-1", "Porto", "location", None, None, "editorial_dossier"), (SINO, "Sino", "concept", None, None, "editorial_dossier")], key=repr)
    assert at.read("aliases") == [(ANA, "Ana", "a.yaml"), (ANA, "Aninha", "a.yaml")]
    assert at.read("relationships") == [(ANA, "place-1", "lives_in", "s2", None, "a.yaml")]
    assert at.read("states") == [(ANA, "s1", "age", "30", "a.yaml"), (ANA, "s1", "mood", '"calm"', "a.yaml")]
    assert [(r[2], r[3], r[4], r[5], r[9]) for r in at.read("claims")] == [(ANA, "born_in", "place-1", None, 1.0), (ANA, "age_of", None, "30", 0.5), (SINO, "rings_at", None, "null", 1.0)]
    assert {(r[0], r[3], r[6]) for r in at.read("predicates")} == {("born_in", "entity", None), ("age_of", "number", "year"), ("rings_at", None, None)}
    assert sorted((r[0], r[1], r[2], r[3]) for r in at.read("mentions")) == sorted([(ANA, "s1", 0, 8), (ANA, "s1", 0, 3), (ANA, "s1", 26, 32), ("place-1", "s1", 19, 24), (SINO, "s2", 2, 6), (ANA, "s2", 14, 17)])
    # Another file knows Ana by name, and says nothing about her description.
    at(json.dumps({"entities": [{"name": "Ana Lima", "type": "character", "aliases": ["Ana", "Doutora"]}], "claims": [{"subject": "SINO", "predicate": "age_of", "value": 90, "scene_uid": "s2"}]}), "b.yaml")
    assert at.read("entities")[0][3] is not None or at.read("entities")[1][3] is not None
    assert at.read("aliases") == [(ANA, "Ana", "a.yaml"), (ANA, "Aninha", "a.yaml"), (ANA, "Doutora", "b.yaml")]
    assert len(at.read("claims")) == 4
    # The first file again, with less in it: only what it had brought goes.
    at("schema_version: 1\nentities:\n  - {name: Porto, type: location, uid: place-1, universe_uid: u-1}\n")
    assert at.read("aliases") == [(ANA, "Doutora", "b.yaml")] and [r[2] for r in at.read("claims")] == [SINO]
    assert at.read("relationships") == [] and at.read("states") == [] and len(at.read("entities")) == 3
    assert ("place-1", "Porto", "location", None, "u-1", "editorial_dossier") in at.read("entities")
    assert [(r[0], r[2], r[3], r[4]) for r in at.read("runs")] == [("a.yaml", 1, 3, 3), ("a.yaml", 3, 1, 0), ("b.yaml", 2, 1, 1)]
    at("# nothing yet\n", "b.yaml")
    assert at.read("claims") == [] and len(at.read("entities")) == 3


#: A file, the path of an issue in it, and a part of its message.
BROKEN = [
    ("- a", "$", "root"), ("a: [", "$", "parsed"), ("schema_version: 2", "schema_version", "must be 1"), ("other: 1", "$", "neither"), ("entities: {a: 1}", "entities", "list"), ("entities: [a]", "entities[0]", "map"),
    ("entities: [{name: ' '}]", "entities[0].name", "text"), ("entities: [{name: 5}]", "entities[0].name", "text"), ("entities: [{name: A}, {name: a}]", "entities[1].name", "twice"), ("entities: [{name: A, type: ghost}]", "entities[0].type", "type"),
    ("entities: [{name: A, aliases: [1]}]", "entities[0].aliases", "texts"), ("entities: [{name: A, attributes: {x: 1}}]", "entities[0].state_scene_uid", "needed"), ("entities: [{name: A, attributes: {x: 1}, state_scene_uid: s9}]", "entities[0].state_scene_uid", "unknown scene"),
    ("entities: []\npredicates: [{value_kind: any}]", "predicates[0].code", "needed"), ("entities: []\npredicates: [{code: c, value_kind: odd, cardinality: two, temporal_mode: x}]", "predicates[0].cardinality", "single"),
    ("entities: [{name: A}]\nrelationships: [{source: A}]", "relationships[0].target", "needed"), ("entities: [{name: A}]\nrelationships: [{source: A, target: B}]", "relationships[0].target", "unknown entity"),
    ("entities: [{name: A}]\nclaims: [{subject: A, predicate: p, scene_uid: s1}]", "claims[0]", "either"), ("entities: [{name: A}]\nclaims: [{subject: A, predicate: p, scene_uid: s1, value: 1, object_entity: A}]", "claims[0]", "either"),
    ("entities: [{name: A}]\nclaims: [{subject: A, predicate: p, scene_uid: s1, value: 1, valid_to_scene_uid: s2}]", "claims[0].valid_from_scene_uid", "needed"), ("entities: [{name: A}]\nclaims: [{subject: B, predicate: p, scene_uid: s7, value: 1}]", "claims[0].scene_uid", "unknown scene"),
    ("entities: [{name: A}]\npredicates: [{code: p, value_kind: number}]\nclaims: [{subject: A, predicate: p, scene_uid: s1, value: x}]", "claims[0]", "kind"), ("entities: [{name: A}]\npredicates: [{code: p, allows_literal_object: false}]\nclaims: [{subject: A, predicate: p, scene_uid: s1, value: x}]", "claims[0].predicate", "object"),
]
#: These can be seen only once names and places are resolved.
LATER = ("unknown scene", "unknown entity", "kind", "object")


def test_contract(spark, tmp_path):
    early = [b for b in BROKEN if b[2] not in LATER]
    for k, (text, _, _) in enumerate(early):
        (tmp_path / f"{k:02d}.yaml").write_text(text)
    found = {}
    for r in Y.contract_issues(Y.items(spark, str(tmp_path))).collect():
        found.setdefault(int(r.source[:2]), []).append((r.path, r.message))
    for k, (_, path, message) in enumerate(early):
        assert any(p == path and message in m for p, m in found[k]), (early[k], found[k])


def test_references(spark, tmp_path):
    late = [b for b in BROKEN if b[2] in LATER]
    for k, (text, _, _) in enumerate(late):
        (tmp_path / f"{k}.yaml").write_text(text.replace("name: A", f"name: A{k}").replace(": A,", f": A{k},").replace("code: p", f"code: p{k}").replace("predicate: p", f"predicate: p{k}"))
    store = Y.create(spark, scratch(spark, "knowledge"))
    files = Y.items(spark, str(tmp_path))
    assert Y.contract_issues(files).count() == 0
    with pytest.raises(Y.ContractError) as err:
        Y.sync(store, files, spark.createDataFrame(SCENES, "scene string, content string, active boolean"), "w")
    for k, (_, path, message) in enumerate(late):
        assert any(s == f"{k}.yaml" and p == path and message in m for s, p, m in err.value.issues), (late[k], err.value.issues)
    assert store.version() == 1


def test_old_dossiers(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("personagens:\n  - {nome: Rui, papel: pai, idade: 50}\n  - {papel: x}\n")
    got = [(r.kind, r.item) for r in Y.items(spark, str(tmp_path / "p.yaml")).collect()]
    assert [k for k, _ in got] == ["file", "entities"] and json.loads(got[1][1]) == {"name": "Rui", "type": "character", "description": "pai"}
    assert Y.contract_issues(Y.items(spark, str(tmp_path / "p.yaml"))).count() == 0


def test_a_failure_between_tables_changes_none(at):
    at(FIRST)
    before = {t: at.read(t) for t in Y.TABLES}

    def fail(name):
        if name == "claims":
            raise OSError("disk full")

    with pytest.raises(OSError):
        at("schema_version: 1\nentities: [{name: New}]", between=fail)
    assert {t: at.read(t) for t in Y.TABLES} == before and at.store.version() == 2

    def other(name):
        if name == "entities":
            at.store.commit(meta={"x": 1})

    with pytest.raises(Conflict):
        at("schema_version: 1\nentities: [{name: New}]", between=other)
    assert {t: at.read(t) for t in Y.TABLES} == before
