"""The corpus pipeline: stages against brute force or SQL, and the whole run."""

from __future__ import annotations

import os
from collections import Counter

import corpus_pipeline
from emberframe.llm import decontam, mixing, training_order
from emberframe.llm.common import table
from tests.compare import DATA, TABLES, sql_rows
from tests.llm.test_operators import jaccard_groups


def folder(tmp_path, name, docs):
    """A data folder with ``docs`` as its documents and the other tables as they are."""
    out = tmp_path / name
    out.mkdir()
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{DATA}/sf0.001/{t}.parquet", out / f"{t}.parquet")
    docs.write.parquet(str(out / "documents.parquet"))
    return str(out)


def test_stages_and_run(spark, tmp_path):
    sf_dir = f"{DATA}/sf0.001"
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = folder(tmp_path, "good", stages[0](spark, table(spark, sf_dir, "documents"), sf_dir))
    rows = sorted(table(spark, good, "documents").select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    assert 0 < len(rows) < table(spark, sf_dir, "documents").count()

    once = folder(tmp_path, "once", stages[1](spark, table(spark, good, "documents"), sf_dir))
    left = sorted(r.doc_id for r in table(spark, once, "documents").select("doc_id").collect())
    assert left == [rows[i].doc_id for i in sorted(set(jaccard_groups([r.text for r in rows])))] and len(left) < len(rows)

    clean = folder(tmp_path, "clean", stages[2](spark, table(spark, once, "documents"), sf_dir))
    names, found = sql_rows(decontam.ORACLE, once)
    hit = {r[names.index("doc_id")] for r in found}
    left = [i for i in left if i not in hit]
    assert sorted(r.doc_id for r in table(spark, clean, "documents").select("doc_id").collect()) == left

    mixed = stages[3](spark, table(spark, clean, "documents"), sf_dir).select("doc_id", "text").collect()
    names, wanted = sql_rows(mixing.ORACLE, clean)
    at = {k: names.index(k) for k in ("doc_id", "size", "taken")}
    assert Counter(r.doc_id for r in mixed) == Counter({r[at["doc_id"]]: round(r[at["taken"]] / r[at["size"]]) for r in wanted if r[at["taken"]]})

    out = str(tmp_path / "shards")
    corpus_pipeline.run(spark, sf_dir).write.parquet(out)
    ids = sum(len(p) for *_, p in training_order.read_from(spark, out, 0))
    assert ids == sum(len(r.text.encode()) + 1 for r in mixed)


def test_empty_documents(spark, tmp_path):
    none = folder(tmp_path, "none", table(spark, f"{DATA}/sf0.001", "documents").limit(0))
    assert corpus_pipeline.run(spark, none).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, table(spark, none, "documents"), none)
        assert left.count() == 0 and left.columns == table(spark, none, "documents").columns


def test_odd_documents(spark, tmp_path):
    """Nulls everywhere, repeated rows, a long text and further columns whose names the operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, id long, slice int, block int"
    long = " ".join(f"w{i % 5000}x{i % 7}" for i in range(60_000))
    rows = [(1, "a text that is kept", "en", "s"), (1, "a text that is kept", "en", "s"), (None, "a text that is kept", None, None), (2, None, None, None), (None, "", "en", "s"), (3, long, "en", "s"), (4, long + " and more", "fr", None)]
    docs = spark.createDataFrame([(i, t, l, s, 0, 0.5, "k", 7, 1, 2) for i, t, l, s in rows], schema)
    odd = folder(tmp_path, "odd", docs)
    once = corpus_pipeline.drop_near_copies(spark, table(spark, odd, "documents"), odd)
    assert once.columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in once.collect()) == [(1, 19), (2, 0), (3, len(long))]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table(spark, odd, "documents"), odd).columns == docs.columns
    assert corpus_pipeline.write_training_order(spark, table(spark, odd, "documents"), odd).count() > 0
