"""Registered queries run over the smallest tables; those with SQL equal it."""

import os
from glob import glob

import duckdb
import pytest

from gridindex.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, documents, name):
    pytest.importorskip("public_tokenizers")
    out = queries.QUERIES[name](spark, SF)
    rows = out.collect()
    if name == "op11_equal_average":
        assert len(rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    elif name == "op1_latent_leaks":
        assert len(rows) <= documents
    elif name == "op12_spelling_automata":
        assert len({r.word for r in rows}) == len(rows) > 0
    else:
        assert len(rows) == documents
    if name not in queries.ORACLES:
        return
    con = duckdb.connect()
    for path in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(cursor.fetchall())
