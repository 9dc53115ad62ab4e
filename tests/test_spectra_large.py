import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import spectral
from lattica.plans.inputs import triangles, vertices

SF = "/root/testdata/sf0.001"


def refused(*_, **__):
    raise AssertionError("an eigenvalue problem was solved")


def test_power_sums_and_kernel_equal_the_spectrum(spark, monkeypatch):
    t = triangles(spark, SF)
    values = np.array([r.value for r in spectral.spectrum(t, vectors=False).collect()])
    monkeypatch.setattr(spectral, "spectrum", refused)
    sums = spectral.power_sums(t).first()
    assert (sums.s1, sums.s2) == pytest.approx((values.sum(), (values**2).sum()))
    base = spectral.kernel(t)
    assert base.select("component").distinct().count() == (abs(values) < 1e-9).sum()
    image = spectral.multiply(spectral.graph_laplacian(t), base.select("vertex_id", "u"), ["u"])
    assert image.filter("abs(u) > 1e-9").isEmpty()
    norms = base.groupBy("component").agg(F.sum(F.col("u") ** 2).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norms)


def test_all_eigenvectors_return_the_mesh(spark, monkeypatch):
    t, v = triangles(spark, SF), vertices(spark, SF)
    whole = {r.vertex_id: (r.x, r.y, r.z) for r in v.collect()}
    monkeypatch.setattr(spectral, "spectrum", refused)
    low = {r.vertex_id: (r.x, r.y, r.z) for r in spectral.low_pass(t, v, 1.0).collect()}
    assert low and all(whole[k] == p for k, p in low.items())
    assert low.keys() == {r.vertex_id for r in spectral.degrees(t).collect()}


@pytest.mark.parametrize("n", [7000, 20_000])
def test_close_eigenvalues_of_a_long_component(n):
    """Those of a path are known, and lie as close as those of a long strip."""
    u = np.arange(n - 1)
    i, j = np.r_[u, u + 1], np.r_[u + 1, u]
    order = np.lexsort((j, i))
    values, vectors = spectral.least_pairs(i[order], j[order], n, 12)
    assert values == pytest.approx(2 - 2 * np.cos(np.pi * np.arange(12) / n), rel=1e-6, abs=1e-14)
    image = spectral._csr_product(i[order], j[order], n)
    assert all(np.abs(image(vectors[:, k]) - values[k] * vectors[:, k]).max() < 1e-9 for k in range(12))


def test_factors_too_large_are_refused(monkeypatch):
    monkeypatch.setattr(spectral, "FACTOR_ENTRIES", 1000)
    u = np.arange(99)
    i, j = np.r_[u, u + 1], np.r_[u + 1, u]
    order = np.lexsort((j, i))
    with pytest.raises(ValueError, match="too large"):
        spectral.least_pairs(i[order], j[order], 100, 5)


def edges_both_ways(pairs):
    e = np.unique(np.array([*pairs, *[(b, a) for a, b in pairs]]), axis=0)
    n = int(e.max()) + 1
    dense = np.zeros((n, n))
    dense[e[:, 0], e[:, 1]] = -1
    return e[:, 0], e[:, 1], n, dense - np.diag(dense.sum(axis=1))


STRIP = [(k, k + s) for k in range(900) for s in (1, 30, 29) if k + s < 900 and k % 7 and (k % 30 or s != 29) and (k % 30 < 29 or s != 1)]
STAR = [(0 if s == 0 else a * 20 + s, a * 20 + s + 1) for a in range(5) for s in range(20)]


@pytest.mark.parametrize("pairs", [STRIP, STAR])
def test_least_values_need_no_basis_and_occur_as_often_as_they_do(pairs):
    keep = {0} if pairs is STAR else {1}
    while True:  # the component of one vertex, numbered anew
        more = keep | {b for a, b in pairs if a in keep} | {a for a, b in pairs if b in keep}
        if more == keep:
            break
        keep = more
    place = {v: p for p, v in enumerate(sorted(keep))}
    i, j, n, dense = edges_both_ways([(place[a], place[b]) for a, b in pairs if a in keep])
    want = np.linalg.eigvalsh(dense)
    for k in (1, 7, 60):
        assert spectral.least_values(i, j, n, k) == pytest.approx(want[:k], abs=1e-9)
    cuts = np.linspace(-1, 13, 40)
    assert list(spectral.Banded(i, j, n).count(cuts)) == [(want < c).sum() for c in cuts]


def test_values_beyond_the_bound_of_pairs(spark, monkeypatch):
    t = triangles(spark, SF)
    want = [r.value for r in spectral.smallest_spectrum(t, 120, vectors=False).orderBy("rank").collect()]
    monkeypatch.setattr(spectral, "DENSE_VERTICES", 30)
    got = [r.value for r in spectral.smallest_spectrum(t, 120, vectors=False).orderBy("rank").collect()]
    assert got == pytest.approx(want, abs=1e-9)
