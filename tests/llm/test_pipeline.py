"""The pipeline's stages against plain versions, on a fixture with planted cases."""

import hashlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(["ba", "de", "ki", "lo", "mu", "ne", "po", "ra"], 3))
    items = [(i, " ".join(word() + "q" for _ in range(30))) for i in range(10)]
    docs, labels = [], []
    for i in range(240):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            w[7] = "grubble"
        docs.append((i, " ".join(w), "en", f"src{i % 3}", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(1001, docs[1][1], "en", "s", 1), (1002, docs[2][1] + " end", "en", "s", 1), (1003, " ".join(word() for _ in range(40)) + " " + items[2][1] + " tail", "en", "s", 1)]
    docs += [(1004, " ".join(word() for _ in range(40)) + " token = " + hashlib.md5(b"x").hexdigest(), "en", "s", 1), (1005, None, None, None, None), (1006, "", "en", "s", 0)]
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns, name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    gone = [a - b for a, b in zip(kept, kept[1:])]
    toxic = {i for i in range(240) if i % 4 == 0}
    assert toxic <= gone[0] and len(gone[0] - toxic) <= 3
    assert gone[1] == {1001, 1002} - gone[0] and gone[2] == {1003} and gone[3] == {1004}
    assert {1005, 1006} <= kept[-1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept[-1]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_decide_on_rows(spark, folder, name):
    """Repeated and null ids, nulls in any column, extra columns with clashing names, and an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    prose = " ".join(f"word{i}" for i in range(40))
    leak = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    bad = {"toxicity": "grubble " * 8, "near_duplicates": prose, "decontamination": leak, "secret_scan": "password: hunter2222", "packing": ""}[name]
    rows = [(901, prose, "en"), (901, bad, None), (None, bad, "en"), (None, "short and clean", None), (902, None, "en"), (902, "", None)]
    # The classifier learns from the stage's own documents.
    learned = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 900").collect()] if name == "toxicity" else []
    schema = "doc_id bigint, text string, lang string"
    docs = spark.createDataFrame([(*r, *["x"] * 9) for r in rows + learned], schema + ", score string, rid string, node string, matches string, start string, row string, kept string, `a.b` string, sequence_id string")
    got = stage(spark, docs, folder)
    if name == "packing":
        assert sorted(r.doc_id or -1 for r in got.collect()) == [-1, -1, 901, 901, 902, 902]
    else:
        left = sorted(((r.doc_id, r.text, r.lang) for r in got.where("doc_id IS NULL OR doc_id > 900").collect()), key=str)
        if name == "near_duplicates":
            # Of the three rows with one text, one with the smallest id stays.
            assert len(left) == 4 and sum(x[1] == prose for x in left) == 1 and all(x[0] == 901 for x in left if x[1] == prose)
        else:
            assert left == sorted([r for r in rows if r[1] != bad], key=str)
        assert got.columns == docs.columns
    assert stage(spark, docs.limit(0), folder).count() == 0
