"""k-NN by hash tables against the exact search."""

import numpy as np
import pytest

from nightjar.operators import vectors as V


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 12)) * 3
    rows = [(i, int(i % 5), (centres[i % 30] + rng.normal(size=12)).tolist()) for i in range(3000)]
    rows += [(5000 + i, 9, centres[0].tolist()) for i in range(1500)]        # one cell holds a third of all rows
    df = spark.createDataFrame(rows, "vec_id long, label int, vec array<double>").repartition(4).cache()
    return df.where("vec_id % 10 <> 0"), df.where("vec_id % 10 = 0")


def found(df):
    return {(r["q_id"], r["rank"]): (r["t_id"], r["t_label"], round(r["dist"], 9)) for r in df.collect()}


def test_recall_and_hot_cells(spark, vectors):
    train, queries = vectors
    exact = V.knn(train, queries, 3)
    got = V.knn_indexed(train, queries, 3, n_cells=40, block_rows=200, n_sample=100)
    r = V.recall_of(got, exact).first()
    assert r["n_queries"] == queries.count() and r["n_found"] >= 0.9 * r["n_true"]
    assert got.groupBy("q_id").count().where("count > 3").isEmpty()
    blocks = V._cells(train, "vec_id", "vec", train["label"], V.HashTables([np.zeros((1, 12))]), 1)
    assert blocks.count() == train.count()


def test_all_cells_give_the_exact_result(vectors):
    train, queries = vectors
    got = V.knn_indexed(train, queries, 3, n_cells=5, recall=1.0, block_rows=500, n_sample=450)
    assert V.recall_of(got, V.knn(train, queries, 3)).first()["n_found"] >= 0.99 * 3 * queries.count()
    assert found(V.knn_indexed(train, queries, 3)) == found(V.knn(train, queries, 3))      # few rows: the exact search


def test_infonce_matches_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(b, i, rng.normal(size=6).tolist(), rng.normal(size=6).tolist()) for b in range(3) for i in range(b + 2)]
    df = spark.createDataFrame(rows, "batch long, vec_id long, z1 array<double>, z2 array<double>")
    got = {r["batch"]: (r["n"], r["loss"]) for r in V.info_nce(df, "z1", "z2").collect()}
    for b in range(3):
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        own = [(unit(x), unit(y)) for c, _, x, y in rows if c == b]
        loss = [np.log(sum(np.exp(x @ y / 0.5) for _, y in own)) - x @ own[i][1] / 0.5 for i, (x, _) in enumerate(own)]
        assert got[b] == (len(own), pytest.approx(np.mean(loss)))
    with pytest.raises(ValueError):
        V.info_nce(spark.range(V.MAX_BATCH + 1).selectExpr("id AS vec_id", "1 AS batch", "array(1.0D) AS z1", "array(1.0D) AS z2"), "z1", "z2")
