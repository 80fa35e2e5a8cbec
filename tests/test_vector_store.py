"""The growing vector store against plain numpy: deltas, both rounds, ties, unfinished deltas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.operators import similarity
from logspark.operators.vector_store import VectorStore

K = 5


def made_up(n=1500, dim=16, groups=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 3
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.3
    x[: n // 3] = x[0]  # a third of the rows are one vector
    return np.round(x, 3)


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in x[i]], f"line {i}") for i in ids], "corpus_id long, vector array<double>, line string")


def best(x, q, unit):
    if unit:
        x, q = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q)
    return np.round(x @ q, 6)


@pytest.mark.parametrize("unit", [False, True])
def test_exact_search_over_deltas(spark, tmp_path, unit):
    x = made_up()
    store = VectorStore.create(spark, str(tmp_path / "store"), frame(spark, x, range(0, 1500, 3)), cells=12, unit=unit)
    for part in range(4):
        store.append(frame(spark, x, range(part, 1500, 4)))
    store.append(spark.createDataFrame([(9999, None, "none")], "corpus_id long, vector array<double>, line string"))
    asked = [7, 600, 900, 1200, 1499]
    queries = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in asked] + [(77, None)], "query_id long, vector array<double>")
    rows = store.search(queries, K, columns=("line",), block=100).collect()
    assert {r["query_id"] for r in rows} == set(asked) and all(r["line"] == f"line {r['corpus_id']}" for r in rows)
    for i in asked:
        own = sorted((r["rank"], r["corpus_id"], round(r["similarity"], 6)) for r in rows if r["query_id"] == i)
        values = best(x, x[i], unit)
        want = np.sort(values)[::-1][:K]
        assert [o[0] for o in own] == [1, 2, 3, 4, 5] and np.allclose([o[2] for o in own], want, atol=1e-5)
        assert all(abs(values[o[1]] - o[2]) < 1e-5 for o in own)
    assert all(r["cells"] <= len(store.cells()) for r in rows)
    if unit:
        assert min(r["cells"] for r in rows) < len(store.cells())  # distant cells are not read
    near = store.search(queries, K, exact=False, block=100).collect()
    by = lambda rows: {(r["query_id"], round(r["similarity"], 6), r["rank"]) for r in rows}
    assert len(by(near) & by(rows)) >= 0.9 * len(rows)
    packed = store.compact(str(tmp_path / "packed"))
    assert by(packed.search(queries, K).collect()) == by(rows) and packed.rows().count() == 1500


def test_unfinished_delta_is_not_seen(spark, tmp_path):
    x = made_up(60, 4, 2, 1)
    store = VectorStore.create(spark, str(tmp_path / "s"), frame(spark, x, range(60)))
    store.append(frame(spark, x, range(30)))
    frame(spark, x, range(30, 60)).withColumns({"far": F.lit(0.0), "delta": F.lit("dbroken"), "cell": F.lit(0)}).write.mode("append").partitionBy("delta", "cell").parquet(f"{store.path}/data")
    assert store.rows().count() == 30
    queries = frame(spark, x, [45]).select(F.col("corpus_id").alias("query_id"), "vector")
    assert {r["corpus_id"] for r in store.search(queries, 40).collect()} == set(range(30))
    with pytest.raises(ValueError):
        VectorStore.create(spark, str(tmp_path / "e"), frame(spark, x, [0]).limit(0))


def test_both_metrics_in_one_pass(spark):
    x = made_up(40, 4, 2, 2)
    a = frame(spark, x, range(0, 40, 5)).select(F.col("corpus_id").alias("query_id"), "vector")
    b = frame(spark, x, range(40))
    both = {(r["query_id"], r["corpus_id"]): r for r in similarity.similarity_matrices(a, b, block=9).collect()}
    assert len(both) == 8 * 40
    for (i, j), r in both.items():
        assert np.isclose(r["dot"], x[i] @ x[j]) and np.isclose(r["euclidean"], -np.linalg.norm(x[i] - x[j]), atol=1e-6)
    top = similarity.top_k_similar(a, b, 3, "euclidean", block=7).collect()
    for r in top:
        assert np.isclose(r["similarity"], sorted((-np.linalg.norm(x[r["query_id"]] - y) for y in x), reverse=True)[r["rank"] - 1], atol=1e-6)
    ties = [r["corpus_id"] for r in sorted(top, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert ties == [0, 1, 2]  # equal vectors by id
    with pytest.raises(ValueError):
        similarity.similarity_matrix(a, b, "odd")


def test_search_over_many_partitions(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(400, 8))
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        store = VectorStore.create(spark, str(tmp_path / "many"), frame(spark, x, range(400)), cells=6)
        store.append(frame(spark, x, range(400)))
        queries = frame(spark, x, range(0, 400, 40)).select(F.col("corpus_id").alias("query_id"), "vector")
        rows = store.search(queries, K, block=50).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    for i in range(0, 400, 40):
        want = list(np.argsort(-(x @ x[i]), kind="stable")[:K])
        assert [r["corpus_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == i] == want
