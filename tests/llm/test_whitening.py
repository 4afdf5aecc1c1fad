import math
from fractions import Fraction

import numpy as np
import pytest

from brute import SF
from fleetrisk.llm import whitening
from fleetrisk.llm.common import table


def grid(vector):
    return [math.floor(64 * c) + 1_000_000 for c in vector]


def check(rows, got, count=16):
    """rows: (vec_id, usable vector); got: collected rows."""
    xs = [(i, grid(v)) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in xs}))
    n, d = fit.shape
    sums = [sum(int(v) for v in column) for column in fit.T]
    centred = np.array([[float(Fraction(int(v)) - Fraction(s, n)) for v, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    assert len(got) == len(xs) * min(count, d)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    for i, x in xs:
        own = np.array([float(Fraction(v) - Fraction(s, n)) for v, s in zip(x, sums)])
        for k in range(min(count, d)):
            r = by[i][k + 1]
            assert r.n == n and r.deviation == sum((n * v - s) ** 2 for v, s in zip(x, sums))
            assert r.explained == pytest.approx(values[k] / centred.var(0).sum(), rel=1e-9)
            assert abs(abs(r.whitened) - abs(own @ vectors[:, k] / math.sqrt(values[k]))) < 1e-6
            assert r.identity_error < 1e-9


def test_given_table_is_dense_eigenvectors(spark):
    df = table(spark, SF, "embeddings")
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in df.collect()]
    found = whitening.digest(whitening.transform(df, whitening.fit(df)))
    assert found.schema["deviation"].dataType.simpleString() == "bigint"
    check(rows, found.collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(k, rng.normal(size=5).tolist()) for k in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    copies = [(200 + k, good[0][1]) for k in range(60)]
    df = spark.createDataFrame(good + bad + copies, "vec_id long, embedding array<double>").selectExpr("*", "1 as dims", "2 as x", "3 as n")
    check(good + copies, whitening.transform(df, whitening.fit(df)).collect())
    twice = spark.createDataFrame([(None, good[0][1]), (1, good[1][1]), (1, good[1][1])], "vec_id long, embedding array<double>")
    got = whitening.transform(twice, whitening.fit(twice)).collect()
    assert len(got) == 15 and {r.n for r in got} == {2}
    assert all((r.whitened is None) == (r.component > 1) for r in got) and all(abs(abs(r.whitened) - 1) < 1e-12 for r in got if r.component == 1)


def test_no_variance_and_empty(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.transform(one, whitening.fit(one)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in got] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    empty = one.limit(0)
    assert whitening.transform(empty, whitening.fit(empty)).count() == 0


def test_sums_are_exact_for_large_entries():
    rng = np.random.default_rng(0)
    z = rng.integers(-(1 << 53), 1 << 53, (50, 3))
    exact = z.astype(object)
    assert (whitening.gram(z) == exact.T @ exact).all() and (whitening.column_sums(z) == exact.sum(0)).all()


@pytest.mark.parametrize("case", ["spread", "equal", "blocks", "close", "rank"])
def test_eigenpairs(case):
    rng = np.random.default_rng(1)
    d = 40
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    values = {"spread": np.geomspace(1e6, 1e-3, d), "equal": np.full(d, 3.0), "blocks": np.repeat([9.0, 4.0], d // 2),
              "close": 1 + 1e-13 * np.arange(d), "rank": np.append(np.arange(1.0, 6), np.zeros(d - 5))}[case]
    v = (q * values) @ q.T if case != "equal" else np.diag(values)
    v = (v + v.T) / 2
    found, vectors = whitening.leading_pairs(v, 16)
    norm = np.abs(values).max()
    assert np.abs(found - np.sort(values)[::-1][:16]).max() < 1e-13 * norm * d
    assert np.abs(v @ vectors - vectors * found).max() < 1e-13 * norm * d
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-10
