"""Whitening against exact sums and numpy's eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import llm
from quillspark.llm import whitening


def brute(vectors):
    """n, exact deviations, eigenvalues and eigenvectors of rows of doubles."""
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for v in vectors], object)
    n, total = len(x), x.sum(axis=0)
    exact = x * n - total
    deviation = (exact**2).sum(axis=1)
    rows = (exact / n).astype(float)
    values, basis = np.linalg.eigh(rows.T @ rows / n)
    return n, deviation.tolist(), rows, values[::-1], basis[:, ::-1]


def check(found, ids, vectors, components=32):
    n, deviation, rows, values, basis = brute(vectors)
    kept = min(components, len(values))
    assert len(found) == len(vectors) * kept
    by = {(r.vec_id, r.component): r for r in found}
    white = np.array([[by[i, k + 1].whitened for k in range(kept)] for i in ids])
    expected = rows @ basis[:, :kept] / np.sqrt(values[:kept])
    signs = np.sign((white * expected).sum(axis=0))
    assert np.abs(white * signs - expected).max() < 1e-8
    assert [by[i, 1].deviation for i in ids] == deviation
    for k in range(kept):
        assert by[ids[0], k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-10)
    centred = white - white.mean(axis=0)
    assert found[0].identity_error == pytest.approx(np.abs(centred.T @ centred / n - np.eye(kept)).max(), abs=1e-12)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9
    assert {r.n for r in found} == {n}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = llm.QUERIES["op11_whitening"](spark, folder)
    assert [t for t in found.dtypes] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(found.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def table(spark, rows, folder):
    path = str(folder)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, row int, id string, deviation string").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_odd_rows(spark, tmp_path):
    numbers = np.random.default_rng(3).normal(size=(40, 5)).astype(np.float32).tolist()
    good = [(i, v, None, 1, "a", "b") for i, v in enumerate(numbers)] + [(100, numbers[0], "x", None, None, None), (101, numbers[0], "x", None, None, None)]
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = good + [(200 + i, v, None, 0, None, None) for i, v in enumerate(bad)]
    folder = table(spark, rows, tmp_path)
    check(llm.QUERIES["op11_whitening"](spark, folder).collect(), [r[0] for r in good], [r[1] for r in good])


def test_components_without_variance_are_left_out(spark):
    numbers = np.random.default_rng(4).normal(size=(30, 3))
    vectors = np.round(np.hstack([numbers, numbers[:, :1], np.ones((30, 1))]) * 64) / 64
    rows, model = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>"))
    assert len(model["eigenvalues"]) == 3 and model["identity_error"] < 1e-9
    assert sum(model["eigenvalues"]) == pytest.approx(model["variance"], rel=1e-12)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_no_variance_gives_no_rows(spark, tmp_path, vectors):
    folder = table(spark, [(i, v, None, 1, None, None) for i, v in enumerate(vectors)], tmp_path)
    found = llm.QUERIES["op11_whitening"](spark, folder)
    assert found.columns[0] == "vec_id" and found.isEmpty()


def test_a_null_id_and_large_entries_stay_exact(spark):
    rows = [(None, [2.0**30, 0.0]), (1, [-(2.0**30), 1.0]), (2, [5.0, 7.0])]
    found, model = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    _, deviation, *_ = brute([v for _, v in rows])
    assert {r.id: int(r.deviation) for r in found.collect()} == dict(zip([None, 1, 2], deviation))
    with pytest.raises(Exception, match="2\\^30"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>"))


def test_deviations_beyond_long():
    x = np.array([[1 << 40, 0], [0, 1 << 40]])
    exact = whitening.centred(x, 1 << 30, [5, 7])
    assert exact.dtype == object and exact[0, 0] == (1 << 70) - 5
