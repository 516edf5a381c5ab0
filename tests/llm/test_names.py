"""Documents whose columns bear the names that the operators use themselves."""

from __future__ import annotations

import pytest

from emberframe.llm import decontam, line_dedup, mixing, periodic, quality, simhash, substring

NAMES = ["_key", "_id", "_copy", "_source", "_text", "_rows", "_copies", "_own", "_keep", "key", "id", "score", "keep", "c0", "slice", "first", "apart", "__key"]


@pytest.fixture(scope="module")
def table(spark):
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    rows = [(i, f"text number {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "a" if i % 3 else "b", *(f"{n} of {i}" for n in NAMES)) for i in range(24)]
    return spark.createDataFrame(rows, schema).repartition(3)


def carried(out, table):
    """All columns are there, and each row's own."""
    assert out.columns == table.columns
    rows = out.collect()
    for r in rows:
        assert [r[n] for n in NAMES] == [f"{n} of {r.doc_id}" for n in NAMES]
    return {r.doc_id for r in rows}


def test_columns_come_back(spark, table):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(24)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(f"w5x{j}" for j in range(20)))], "item_id long, text string")
    everything = set(range(24))
    assert carried(mixing.mixed_documents(table), table) <= everything
    assert carried(decontam.decontaminated(table, bench), table) == everything - {5}
    assert carried(line_dedup.deduplicated(table), table) == everything
    assert carried(simhash.one_of_each(table), table) == everything
    assert carried(quality.accepted(table, labels), table) <= everything
    assert carried(substring.deduplicated(table), table) == everything
    assert carried(periodic.collapsed(table), table) == everything
