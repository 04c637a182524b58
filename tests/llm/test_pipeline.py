"""The pipeline's stages against brute force, each on its own input."""

import random
import re

import corpus_pipeline as C
from quillon.llm import quality

WORDS = "lorem ipsum dolor sit amet sed quia non velit magna".split()


def tables(spark, root):
    rng = random.Random(3)
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = []
    for d in range(160):
        w = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(rng.randint(60, 90))]
        rows.append((d, " ".join(x.upper() + "!!" for x in w) if d % 5 == 0 else " ".join(w) + "."))
    rows += [(200, rows[1][1]), (201, rows[1][1]), (202, rows[2][1] + " tail"), (203, rows[3][1] + " " + item), (None, None)]
    docs = [(d, t, "en", f"s{k % 3}", len(t or "")) for k, (d, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(d, int(d % 5 != 0), 0) for d in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")


def sets(t):
    w = re.findall(r"\S+", t.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def test_stages(spark, tmp_path):
    root = str(tmp_path)
    tables(spark, root)
    assert [s for s, _ in C.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(C.STAGES):
        before = docs.collect()
        out = stage(spark, docs, root)
        out.write.parquet(f"{root}/stage{k}")
        docs = spark.read.parquet(f"{root}/stage{k}")
        rows = docs.collect()
        kept.append(len(rows))
        if k < 4:
            assert docs.columns == columns
        ids = {r.doc_id for r in rows}
        if k == 0:
            assert {r.doc_id for r in before if r.doc_id is not None and r.doc_id < 160 and r.doc_id % 5} <= ids
            assert not any(d is not None and d < 160 and d % 5 == 0 for d in ids)
        if k == 1:
            best = {}
            for r in before:
                best[r.text or ""] = max(best.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == sorted(best.values())
        if k == 2:
            gone = {b.doc_id for a in before for b in before if a.doc_id is not None and b.doc_id is not None and a.doc_id < b.doc_id and sets(a.text or "") and 100 * len(sets(a.text) & sets(b.text)) >= 80 * len(sets(a.text) | sets(b.text))}
            assert ids == {r.doc_id for r in before} - gone and gone
        if k == 3:
            assert ids == {r.doc_id for r in before if not (r.text and "two three four five six seven eight" in r.text)} and 203 not in ids
    assert kept[4] == kept[3] and "mix_rate" in docs.columns
    assert quality.THRESHOLD == 0.7


def test_run_is_the_stages(spark, tmp_path):
    root = str(tmp_path)
    tables(spark, root)
    out = C.run(spark, root)
    assert out.count() > 50 and out.where("mix_rate < 0").count() == 0


def test_no_rows(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert C.run(spark, root).count() == 0


def test_repeated_ids_long_texts_and_clashing_columns(spark, tmp_path):
    root = str(tmp_path / "a")
    tables(spark, root)
    docs = spark.read.parquet(f"{root}/documents.parquet").selectExpr("*", "1 AS mix_rate", "2 AS key", "map('a', 1) AS _chance")
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice(WORDS) + rng.choice("ijklmnop") for _ in range(n)) + "."
    more = [(7, words(70)), (7, words(70)), (300, words(60000)), (301, ""), (301, "")]
    more = spark.createDataFrame([(d, t, "en", None, 0, 1, 2, {"a": 1}) for d, t in more], docs.schema)
    clash = str(tmp_path / "b")
    docs.unionByName(more).write.parquet(f"{clash}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{t}.parquet").write.parquet(f"{clash}/{t}.parquet")
    out = C.run(spark, clash).select("doc_id", "mix_rate", "_mix_rate", "_chance", "text").collect()
    assert all(r.mix_rate == 1 and r._mix_rate >= 0 and r._chance == {"a": 1} for r in out)
    assert sorted(r.doc_id for r in out if r.doc_id in (7, 300)) == [7, 7, 7, 300]
    assert len([r for r in out if r.doc_id == 300 and len(r.text.split()) == 60000]) == 1


def test_a_run_leaves_other_tables_alone(spark, tmp_path):
    """A frame that reads tables of its own outlives a pipeline run."""
    from quillon.llm import exact_dedup

    root = str(tmp_path)
    tables(spark, root)
    held = exact_dedup.keep_table(spark.read.parquet(f"{root}/documents.parquet"))
    first = C.run(spark, root)
    n = C.run(spark, root).count()
    assert held.count() == spark.read.parquet(f"{root}/documents.parquet").count()
    assert first.count() == n
