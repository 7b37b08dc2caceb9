"""Registered training-data queries: columns, and their check SQL on the smallest tables."""

import numpy as np
import pytest

from artifactlake.llm import queries
from tests.oracle import connect, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = connect(SF).execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    named = queries.QUERIES["op5_language_id"](spark, SF).join(docs, "doc_id").where("held_out")
    assert named.where("lang = lang_pred").count() >= 0.95 * named.count() > 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = queries.QUERIES["op8_quality_scores"](spark, SF).join(labels, "doc_id").where("held_out")
    assert scored.where("predicted = quality").count() >= 0.9 * scored.count() > 0


def test_whitening_query_equals_a_dense_eigensolver(spark):
    got = queries.QUERIES["op11_embedding_whitening"](spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(rows.embedding.values).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    a = (n * x - s) / n
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1], q[:, ::-1]
    white = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].values
    want = a @ q[:, :32] / np.sqrt(e[:32])
    assert len(got) == 32 * n and np.allclose(white * np.sign((white * want).sum(0)), want, atol=1e-9)
    first = got[got.component == 1].set_index("vec_id").loc[rows.vec_id]
    assert (first.deviation.values == ((n * x - s) ** 2).sum(1)).all() and (got.n == n).all()
    share = got.groupby("component").explained.first().values
    assert np.allclose(share, e[:32] / e.sum(), rtol=1e-9) and got.identity_error.max() < 1e-9
