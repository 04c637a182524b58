"""Backups, rebuilds, reports, images, SQL functions, tools, configured rules and the whole of a dossier."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.functions import hashing as H
from quillon.functions import sql
from quillon.functions import text as T
from quillon.operators import assets as X
from quillon.operators import audit as A
from quillon.operators import governance as G
from quillon.operators import knowledge as K
from quillon.operators import relational as R
from quillon.plans import tools
from quillon.sources import files


def test_swap_survives_a_crash_between_renames(spark, tmp_path):
    path = str(tmp_path / "set")
    files.write_atomic(spark.range(3), path)
    os.rename(path, f"{path}.old-00000000000000000001")
    files.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    os.rename(path, f"{path}.old-00000000000000000001")
    files.write_atomic(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not [x for x in os.listdir(tmp_path) if ".old-" in x or ".new-" in x]


def test_backups_and_rebuild(spark, tmp_path):
    path, src = str(tmp_path / "set"), tmp_path / "src"
    src.mkdir()
    with pytest.raises(FileNotFoundError):
        files.rebuild(spark, f"{src}/*", path, lambda t: t)
    for k in range(4):
        (src / f"{k}.md").write_text(f"# {k}\n")
        saved = files.rebuild(spark, f"{src}/*", path, lambda t: t.select("text"), keep=2)
        assert (saved is None) == (k == 0) and spark.read.parquet(path).count() == k + 1
    kept = files.backups(spark, path)
    assert [spark.read.parquet(b).count() for b in kept] == [2, 3]
    files.restore(spark, kept[0], path)
    assert spark.read.parquet(path).count() == 2
    assert len(files.prune(spark, path, 0)) == 2 and not files.backups(spark, path)


def test_markdown_report(spark, tmp_path):
    lines = T.line_table(spark.createDataFrame([(1, "# A\nConcerteza ,sim\n— Concerteza!"), (2, "nada")], "doc_id long, text string"))
    found = A.grammar(lines)
    got = {r.doc_id: r.report for r in files.markdown_report(found, 2).collect()}
    assert list(got) == [1] and got[1].startswith("# Review\n\n4 findings, 2 listed\n\n## erro: `grammar.") and got[1].endswith("*Take the space out.*")
    files.write_markdown(found, str(tmp_path / "r"))
    assert "doc_id=1" in os.listdir(tmp_path / "r")


def png(w, h, colour, icc=False):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + (chunk(b"iCCP", b"x") if icc else b"") + chunk(b"IDAT", b"") + chunk(b"IEND", b"")


def test_images_and_pdfs(spark, tmp_path):
    jpeg = b"\xff\xd8" + b"\xff\xe2" + struct.pack(">H", 15) + b"ICC_PROFILE\0\1" + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 30, 40, 3) + b"\0" * 9
    for name, data in {"a.png": png(7, 5, 2, True), "b.png": png(1, 2, 6), "c.jpg": jpeg, "d.gif": b"GIF89a" + struct.pack("<HH", 9, 8), "e.txt": b"no", "f.png": b"\x89PNG"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.mode, r.format, r.has_icc) for r in files.images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (7, 5, "RGB", "PNG", True), "b.png": (1, 2, "RGBA", "PNG", False), "c.jpg": (40, 30, "RGB", "JPEG", True), "d.gif": (9, 8, "P", "GIF", False), "e.txt": (None,) * 5, "f.png": (None,) * 5}
    (tmp_path / "g.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Type /Pages>> <</Type /Page /MediaBox [0 0 595 842]>> <</Type/Page /MediaBox[0 0 595 842]>> \xff\xfe")
    (tmp_path / "h.pdf").write_bytes(b"%PDF-1.7")
    got = {r.path.rsplit("/", 1)[1]: (r.pages, r.boxes) for r in files.pdfs(spark, str(tmp_path)).collect()}
    assert got == {"g.pdf": (2, [[0.0, 0.0, 595.0, 842.0]]), "h.pdf": (1, [])}


def test_sql_functions(spark):
    assert sql.register(spark) == [n for n, *_ in sql.FUNCTIONS]
    row = spark.sql("SELECT vector_distance(array(1D, 0D), array(0D, 2D)) AS d, fold_text('Çá') AS t, round(bm25(2D, 1D, 3D, 10D, 10D), 6) AS s, rank_fusion(NULL) AS r").first()
    assert (row.d, row.t, row.r) == (1.0, "ca", 0.0) and row.s == pytest.approx(1.348640, abs=1e-5)
    uid = spark.range(50).select(H.random_uid().alias("u")).collect()
    assert len({r.u for r in uid}) == 50 and all(len(r.u) == 32 and int(r.u, 16) >= 0 for r in uid)


def test_time(spark):
    row = spark.sql("SELECT timestamp'2024-03-01 10:00:00.5' AS t, timestamp'2024-03-01 11:00:01' AS n").select(G.iso(F.col("t")), G.epoch(F.col("t")), G.expired(F.col("t"), 3600, F.col("n")), G.expired(F.col("t"), 3601, F.col("n"))).first()
    assert tuple(row) == ("2024-03-01T10:00:00.500000+00:00", 1709287200, True, False)


def test_callable_replacements(spark):
    shout = ("house.shout", "ortografia", r"\bgrite\b", "alerta", 0.9, F.upper)
    lines = T.line_table(spark.createDataFrame([(1, "não grite, Grite.")], "doc_id long, text string"))
    got = A.grammar(lines, extra=(shout,), replacement=True).orderBy("excerpt").collect()
    assert [(r.rule, r.replacement) for r in got] == [("house.shout", "GRITE")] * 2
    assert lines.select(A.autofix(F.col("text"), F.lit(False), extra=(shout,))).first()[0] == "não GRITE, GRITE."


CONFIG = """
framework: atos
registro: [{titulo: Um}, {titulo: Dois}]
revisao:
  coerencia:
    estados: [{id: e, padroes_terminais: [espada quebrou], padroes_atividade: [usou a espada], escopo: livro}]
    sequencias: [{id: s, marcos: [{padroes: [partiu]}, {padroes: [chegou]}]}]
    fatos_numericos: [{id: f, padroes: ['tinha (?P<valor>\\w+) cães']}]
  factualidade:
    fontes: {a: {titulo: t}}
    alegacoes: [{id: p, padroes: [houve paz], fontes: [a]}]
    termos_temporais: [{id: t, padroes: [telefone], ignorar_secoes: [Notas]}]
  estrutura:
    registro_capitulos: {campo: registro}
    secoes_obrigatorias: [Reflexão]
    elementos_obrigatorios: {atribuicao: true}
    min_palavras_capitulo: 100
  gramatica: {ignorar_regras: [grammar.spelling.menos]}
"""


def test_rules_from_configuration(spark):
    yaml = pytest.importorskip("yaml")
    text = "# Um\nA espada quebrou.\n## Notas\nUsou a espada. O telefone tocou.\n# Tres\nO telefone tocou. Houve paz, menas guerra.\nChegou.\nPartiu.\nEla tinha dois cães.\nEla tinha três cães."
    found = A.configured(T.line_table(spark.createDataFrame([(1, text)], "doc_id long, text string")), yaml.safe_load(CONFIG))
    got = {}
    for r in found.collect():
        got.setdefault(r.rule, []).append(r.line)
    want = {
        "coherence.state.incompatible_after_terminal": [4], "coherence.timeline.milestone_order": [8], "coherence.fact.conflicting_quantity": [10], "factuality.source.incomplete_metadata": [6],
        "factuality.anachronism.temporal_term": [6], "structure.registry.title_or_order_mismatch": [5], "structure.framework.mismatch": [1],
    }
    assert {k: v for k, v in got.items() if k in want} == want
    assert "grammar.spelling.menos" not in got and len(got["structure.section.missing"]) == 2 and len(got["structure.element.missing_attribution"]) == 2 and len(got["structure.chapter.below_min_words"]) == 2


def test_referents(spark):
    said = {"O general, chamado Rui, falou.": ["entity:Rui"], "O velho guerreiro viu a filha.": ["noun:velho guerreiro filha"], "Nada aqui.": [], "Rui dormia ali naquele quarto muito distante da rua onde o pai trabalhava.": ["entity:Rui", "noun:pai"]}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string")
    got = [[x.name for x in r[0]] for r in df.orderBy("k").select(A.referents(F.col("t"), {"Rui": "masculino"}, A.PERSONS)).collect()]
    assert got == list(said.values())


def test_long_redirect_chain_without_a_checkpoint_folder(spark):
    n = 1 << 12
    edges = spark.range(n).select(F.col("id").alias("s"), (F.col("id") + 1).alias("t"))
    out = R.resolve_redirects(edges, "s", "t")
    assert out.count() == n and out.where(F.col("t") != n).count() == 0


def test_cycles(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 102), (102, 100), (102, 7), (0, 100), (9, 200), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node for r in K.on_cycles(df, "a", "b", rounds=3).collect()} == {100, 101, 102, 200, 201}
    assert not K.on_cycles(df.where("a < 50"), "a", "b").collect()


def test_mentions_of_many_aliases(spark):
    texts = spark.createDataFrame([(1, "Ana Lima e ana; mariana, ANA-Lima. " * 300), (2, None)], "doc_id long, text string")
    got = K.mentions(texts, spark.createDataFrame([(1, "Ana"), (2, "Ana Lima"), (3, "Zé")], "entity int, alias string")).collect()
    assert len([r for r in got if r.entity == 1]) == 900 and sorted((r.start, r.end) for r in got if r.entity == 2)[1] == (35, 43)


def test_universe_relations(spark):
    own = spark.createDataFrame([("a", "1", "p", "Rui", "U1", 1), ("b", "1", "p", "RUI", None, 2), ("b", "2", "p", "Ana", None, 3)], "work string, local string, type string, name string, uid string, `order` int")
    found = K.universe_sync(own, spark.createDataFrame([], "entity string, type string, name string"), "6ba7b8119dad11d180b400c04fd430c8")
    got = {(r.work, r.local): (r.entity, r.confidence) for r in found.collect()}
    assert got["a", "1"] == ("U1", 1.0) and got["b", "1"] == ("U1", 0.5) and got["b", "2"][0] not in (None, "U1")
    rel = spark.createDataFrame([("b", "1", "2", "knows"), ("b", "1", "9", "knows")], "work string, source string, target string, type string")
    assert [(r.source, r.target) for r in K.universe_relations(found, rel).collect()] == [("U1", got["b", "2"][0])]


def test_plan_modes(spark):
    books = spark.createDataFrame([(1, 10, None)], "book int, total_pages int, direction array<string>")
    chapters = spark.createDataFrame([(1, 1, "A", 100, "A", 1, 4, 4), (1, 2, "B", 100, None, None, None, None)], "book int, pos int, title string, words int, plan_title string, first int, last int, reflection int")
    scenes = spark.createDataFrame([(1, 1, 1, [], "x", [1, 2], "p", False), (1, 1, 2, ["id"], "", [3, 4], "p", True)], "book int, pos int, scene int, missing array<string>, id string, pages array<int>, asset string, asset_exists boolean")
    rules = lambda **c: sorted(r.rule for r in X.plan_review(books, chapters, scenes, c).collect())
    assert rules(modo="x") == ["invalid_mode"] and rules(modo="sem_imagens") == []
    fixed = {"paginas_por_capitulo": 4, "cenas_por_capitulo": 2, "cenas_internas_em_spread": 2, "paginas_iniciais": 0, "paginas_finais": 2}
    assert rules(**fixed) == ["chapter_count", "duplicate_asset", "incomplete_scene", "missing_art_direction"]
    assert rules(**fixed, fase="producao", modo="abertura_pagina_par") == ["chapter_count", "duplicate_asset", "incomplete_scene", "missing_art_direction", "missing_asset", "scene_pages"]


def test_tools(spark):
    df = spark.createDataFrame
    book = tools.Book(spark, {
        "documents": df([(1, "casa azul"), (2, "mar azul azul")], "doc_id long, text string"), "entities": df([(1, "Rui")], "entity long, name string"), "aliases": df([(1, "Ruizinho")], "entity long, alias string"),
        "relations": df([(1, "knows", 2)], "source long, kind string, target long"), "mentions": df([(1, 1, 1, 1), (1, 1, 9, 1)], "entity long, document int, chapter int, scene int"),
        "scenes": df([("s1", "t", "0")], "scene string, content string, sha string"), "links": df([("next", "s1", "s2", 1.0)], "relationship string, source string, target string, weight double"),
        "derivations": df([("s1", "summary", "stale")], "scene string, kind string, status string"), "governance": df([], "chain string, seq long, payload string, previous_hash string, event_hash string"),
    })
    assert [r["doc_id"] for r in tools.call(book, "search_book_context", query="mar AZUL")] == [2, 1]
    assert tools.call(book, "get_entity_dossier", name="ruizinho", cutoff=(1, 5, 1))["mentions"] == 1
    assert tools.call(book, "get_scene_context", scene="s1")["derivations"] == {"summary": "stale"}
    assert tools.call(book, "verify_book_index")["documents"] == 2
    assert {r["code"] for r in tools.call(book, "audit_book_health")} == {"scene_hash_mismatch", "stale_materializations"}
    event = tools.call(book, "propose_book_knowledge", proposal="p", payload={"a": 1})
    assert event["previous_hash"] is None and len(event["event_hash"]) == 64
    for name, args, error in (("get_scene_context", {"scene": "no"}, LookupError), ("get_entity_dossier", {"name": "no"}, LookupError), ("search_book_context", {"query": " "}, ValueError), ("nothing", {}, LookupError), ("propose_book_knowledge", {"proposal": "p", "payload": {"a": "x" * 70000}}, ValueError)):
        with pytest.raises(error):
            tools.call(book, name, **args)


def test_names_of_any_script(spark):
    """Case and marks are ignored by the collation, without Python; the key that was asked for comes back."""
    from quillon.functions import text as T

    known = spark.createDataFrame([("Άννα", 1), ("Ёлка", 2), ("Łódź", 3), ("ана", 9)], "key string, id long")
    asked = spark.createDataFrame([("ΑΝΝΑ",), ("елка",), ("ЁЛКА",), ("Ана",), ("нет",)], "key string")
    got = K.lookup(asked, [known], collation=T.ANY_CASE)
    assert sorted(map(tuple, got.collect())) == sorted([("ΑΝΝΑ", 1), ("елка", 2), ("ЁЛКА", 2), ("Ана", 9)])
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    local = spark.createDataFrame([(1, None, "ΆΝΝΑ"), (2, "u", "x"), (3, None, "Zoë")], "id long, uid string, name string")
    shared = spark.createDataFrame([(10, None, "άννα"), (20, "u", "y"), (30, None, "zoe")], "eid long, uid string, name string")
    assert sorted(map(tuple, K.match_identity(local, shared, T.ANY_CASE).collect())) == [(1, 10, 0.5), (2, 20, 1.0), (3, 30, 0.5)]
    assert [r[0] for r in K.match_identity(local, shared).where("eid IS NOT NULL").select("id").collect()] == [2]
    one = spark.createDataFrame([("Ünïcode", "unicode"), ("Ναι", "ναί"), ("a", "b")], "x string, y string").select(T.same_text(F.col("x"), F.col("y")))
    assert [r[0] for r in one.collect()] == [True, True, False]


def test_pages_in_compressed_objects(spark, tmp_path):
    import zlib

    body = zlib.compress(b"1 0 2 40 <</Type /Page /MediaBox [0 0 100 200]>> <</Type/Page>> <</Type /Pages /Count 2>>")
    head = b"%PDF-1.5\n3 0 obj\n<</Type /Page /MediaBox [0 0 300 400.5]>>\nendobj\n5 0 obj\n"
    stream = lambda what, data: head + b"<< /Type /ObjStm /N 2 /Extends << /A 1 >> " + what + b" >>\nstream\n" + data + b"\nendstream\nendobj\n"
    for name, data in {"flate.pdf": stream(b"/Filter /FlateDecode", body), "plain.pdf": stream(b"", b"1 0 <</Type /Page>>"), "other.pdf": stream(b"/Filter /LZWDecode", b"?"), "broken.pdf": stream(b"/Filter /FlateDecode", b"no"), "locked.pdf": stream(b"/Filter /FlateDecode", body) + b"trailer <</Encrypt 9 0 R>>"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.pages, r.boxes) for r in files.pdfs(spark, str(tmp_path)).collect()}
    one = [[0.0, 0.0, 300.0, 400.5]]
    assert got == {"flate.pdf": (3, [[0.0, 0.0, 100.0, 200.0], *one]), "plain.pdf": (2, one), "other.pdf": (None, None), "broken.pdf": (None, None), "locked.pdf": (None, None)}


def test_long_chains_are_appended_in_order(spark):
    """Two thousand events of one chain, in two goes, against a fold by hand; null payloads and ties count."""
    import hashlib

    events = [("a", k // 2, None if k % 50 == 0 else f"p{k}") for k in range(2000)] + [("b", 1, "x"), (None, 1, "y")]
    want, last = {}, {}
    for c, o, p in sorted(events, key=lambda e: (e[0] or "", e[1], e[2] is not None, e[2] or "")):
        before = last.get(c)
        own = hashlib.sha256("|".join([before or ""] + ([p] if p is not None else [])).encode()).hexdigest()
        want[c, o, p], last[c] = (before, own), own
    schema = "chain string, seq int, payload string"
    none = spark.createDataFrame([], schema + ", event_hash string")
    first = G.append_chained(none, spark.createDataFrame([e for e in events if e[1] < 600], schema), "chain", "seq", "payload")
    second = G.append_chained(first, spark.createDataFrame([e for e in events if e[1] >= 600], schema), "chain", "seq", "payload")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in first.unionByName(second).collect()}
    assert got == want


def test_prepress_and_ratios(spark):
    from quillon.operators import cover as C

    schema = "cover int, page_count int, isbn string, style string, visual_style string, theme string, template string, palette map<string,string>, brief_score int, brief_missing array<string>, image_dpi double, has_logo boolean, fonts map<string,boolean>, spine_mm double, safe_mm double"
    good = (1, 200, "9780306406157", "serif", None, None, "ilustrado", {"bg_color": "#000000", "gold_color": "#ffffff", "text_light": "#222222", "soft_gold": "red"}, 100, [], 300.0, True, {"title": True, "body": True, "tag": True}, 12.0, 5.0)
    bad = (2, None, None, "", "odd", "neon", "ilustrado", None, 40, ["tom", "público"], None, None, {"title": False}, 3.0, 4.5)
    got = {r.cover: ([(i.severity, i.code, i.detail) for i in r.issues], r.status) for r in C.prepress(spark.createDataFrame([good, bad], schema), ("serif",), ("nanquim",)).collect()}
    assert got[1] == ([("warning", "low_palette_contrast", "text_light 1.32"), ("warning", "rgb_output_pipeline", None)], "passed_with_warnings")
    assert got[2][1] == "failed" and [c for _, c, _ in got[2][0]] == [
        "unreadable_interior_pdf", "invalid_isbn", "unknown_visual_style", "unknown_palette", "incomplete_editorial_brief", "missing_cover_image", "missing_publisher_logo", "missing_local_font", "spine_too_narrow_for_text", "small_safe_area", "rgb_output_pipeline", "font_reproducibility",
    ]
    from fractions import Fraction

    sizes = [(160, 230), (142, 216), (1, 3), (297, 210), (1000, 999), (5, 0)]
    ratios = [r[0] for r in spark.createDataFrame(sizes, "w int, h int").select(C.aspect_ratio(F.col("w"), F.col("h"))).collect()]
    assert ratios == [f"{f.numerator}:{f.denominator}" for f in (Fraction(w, h).limit_denominator(50) for w, h in sizes[:-1])] + [None]
