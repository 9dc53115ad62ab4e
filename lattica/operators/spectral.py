"""Laplacians of meshes as sparse rows (i, j, w), delta coordinates and spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.graph import components
from lattica.operators.hot import join_groups
from lattica.operators.mesh import adjacency, degrees, edges
from lattica.session import materialize

#: A component's spectrum is computed densely up to this many vertices.
DENSE_VERTICES = 6000
#: Beyond, Lanczos holds a basis of some times the pairs wanted, each as long as the component,
LANCZOS_PAIRS = 100
#: and the blocks of a factor, which have this many entries at most.
FACTOR_ENTRIES = 150_000_000
#: Up to this many edges one task labels the components, as one task holds a component afterwards.
LABEL_EDGES = 6_000_000


def adjacency_matrix(triangles: DataFrame) -> DataFrame:
    return adjacency(triangles).select(F.col("u").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("w"))


def graph_laplacian(triangles: DataFrame) -> DataFrame:
    """D - A."""
    diagonal = degrees(triangles).select(F.col("vertex_id").alias("i"), F.col("vertex_id").alias("j"), F.col("degree").cast("double").alias("w"))
    return diagonal.unionAll(adjacency_matrix(triangles).withColumn("w", -F.col("w")))


def random_walk_laplacian(triangles: DataFrame) -> DataFrame:
    """I - D^-1 A; vertices without an edge have no row."""
    d = degrees(triangles).withColumnRenamed("vertex_id", "i")
    diagonal = d.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))
    rest = adjacency_matrix(triangles).join(d, "i").select("i", "j", (-1.0 / F.col("degree")).alias("w"))
    return diagonal.unionAll(rest)


def inverse_degrees(triangles: DataFrame) -> DataFrame:
    return degrees(triangles).select("vertex_id", (1.0 / F.col("degree")).alias("w"))


def delta_coordinates(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vertex_id, dx, dy, dz): each vertex minus the mean of its neighbours."""
    near = adjacency(triangles).join(vertices.withColumnRenamed("vertex_id", "v"), "v")
    means = near.groupBy(F.col("u").alias("vertex_id")).agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    return vertices.join(means, "vertex_id").select("vertex_id", *[(F.col(a) - F.col(f"m{a}")).alias(f"d{a}") for a in "xyz"])


def delta_norms(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    d = delta_coordinates(triangles, vertices)
    return d.select("vertex_id", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2).alias("norm"))


def multiply(matrix: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Sparse matrix times columns of ``values(vertex_id, ..)``."""
    rows = matrix.join(values.withColumnRenamed("vertex_id", "j"), "j")
    return rows.groupBy(F.col("i").alias("vertex_id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def _csr_product(i: np.ndarray, j: np.ndarray, n: int):
    """x to the product of the graph Laplacian with x, for directed edges sorted by i; every vertex has one."""
    starts = np.searchsorted(i, np.arange(n))
    degree = np.diff(np.r_[starts, len(i)])
    return lambda x: degree * x - np.add.reduceat(x[j], starts)


def lanczos(product, n: int, k: int, tolerance: float = 1e-9, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k least eigenvalues, ascending, and eigenvectors of a symmetric operator, by Lanczos with full orthogonalisation.

    Pairs at the low end that have converged are locked; new starts orthogonal to them go on until
    one brings nothing below the k-th, so multiple eigenvalues are found as often as they are.
    """
    rng = np.random.default_rng(seed)
    values, vectors = np.zeros(0), np.zeros((n, 0))
    while True:
        basis = np.zeros((n, min(n - len(values), 64)))
        alpha, beta = [], []
        q = rng.standard_normal(n)
        q -= vectors @ (vectors.T @ q)
        q /= np.linalg.norm(q)
        done = None
        for step in range(n - len(values)):
            if step == basis.shape[1]:
                basis = np.hstack([basis, np.zeros((n, min(n - len(values) - step, step)))])
            basis[:, step] = q
            w = product(q)
            alpha.append(float(q @ w))
            for _ in range(2):
                w -= basis[:, : step + 1] @ (basis[:, : step + 1].T @ w)
                w -= vectors @ (vectors.T @ w)
            size = float(np.linalg.norm(w))
            last = step + 1 == n - len(values) or size < 1e-12
            if last or (step + 1) % 32 == 0:
                t = np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1)
                ritz, s = np.linalg.eigh(t)
                good = np.abs(s[-1]) * size < tolerance
                count = len(ritz) if last else int(np.argmin(np.r_[good, False]))
                if last or count >= min(k, 1 + len(ritz) // 4):
                    done = ritz[:count], basis[:, : step + 1] @ s[:, :count]
                    break
            beta.append(size)
            q = w / size
        found = done[0]
        missed = len(values) < k or found[0] < np.sort(values)[k - 1] - tolerance
        values, vectors = np.r_[values, found], np.hstack([vectors, done[1]])
        if not missed or len(values) >= n:
            order = np.argsort(values, kind="stable")[:k]
            return values[order], vectors[:, order]


def _levels(i: np.ndarray, j: np.ndarray, n: int, least: int = 64) -> list[np.ndarray]:
    """Vertices of a connected graph in blocks, edges only within a block and to the next: distances from a vertex at its rim."""
    starts = np.searchsorted(i, np.arange(n + 1))

    def around(root):
        seen, front, out = np.zeros(n, bool), np.array([root]), []
        seen[root] = True
        while len(front):
            out.append(front)
            counts = starts[front + 1] - starts[front]
            at = np.repeat(starts[front] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            front = np.unique(j[at])
            front = front[~seen[front]]
            seen[front] = True
        return out

    root, levels = 0, around(0)
    while True:  # to the far end, as long as that lies farther
        last = levels[-1]
        root = int(last[np.argmin(starts[last + 1] - starts[last])])
        found = around(root)
        if len(found) <= len(levels):
            break
        levels = found
    blocks, held = [], []
    for level in levels:
        held.append(level)
        if sum(map(len, held)) >= least:
            blocks.append(np.concatenate(held))
            held = []
    return blocks + ([np.concatenate(held)] if held else [])


def _shifted_solver(i: np.ndarray, j: np.ndarray, blocks: list[np.ndarray], shift: float):
    """b to the solution x of (L + shift) x = b for the graph Laplacian L, by elimination block after block."""
    n = sum(map(len, blocks))
    block, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t, b in enumerate(blocks):
        block[b], place[b] = t, np.arange(len(b))
    degree = np.bincount(i, minlength=n)
    order = np.argsort(block[i], kind="stable")
    cuts = np.searchsorted(block[i][order], np.arange(len(blocks) + 1))
    inverses, below = [], []
    for t, b in enumerate(blocks):
        own = order[cuts[t] : cuts[t + 1]]
        a = np.diag(degree[b] + shift)
        inside = own[block[j[own]] == t]
        a[place[i[inside]], place[j[inside]]] = -1.0
        if t:
            back = own[block[j[own]] == t - 1]
            low = np.zeros((len(b), len(blocks[t - 1])))
            low[place[i[back]], place[j[back]]] = -1.0
            below.append(low @ inverses[-1])
            a -= below[-1] @ low.T
        inverse = np.linalg.inv(a)
        inverses.append((inverse + inverse.T) / 2)

    def solve(b):
        parts = [b[blocks[0]]]
        for t in range(1, len(blocks)):
            parts.append(b[blocks[t]] - below[t - 1] @ parts[-1])
        x = np.empty(n)
        x[blocks[-1]] = after = inverses[-1] @ parts[-1]
        for t in range(len(blocks) - 2, -1, -1):
            x[blocks[t]] = after = inverses[t] @ parts[t] - below[t].T @ after
        return x

    return solve


def least_pairs(i: np.ndarray, j: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least eigenpairs of a connected graph's Laplacian, for directed edges sorted by i: Lanczos on the inverse of L + shift.

    The least eigenvalues of a large mesh lie close together, but far apart in the inverse. The shift
    is moved until it is some way below the k-th eigenvalue. ``ValueError`` if the factor is too large.
    """
    blocks = _levels(i, j, n)
    sizes = np.array([len(b) for b in blocks])
    entries = int((sizes**2).sum() + (sizes[1:] * sizes[:-1]).sum())
    if entries > FACTOR_ENTRIES or k > LANCZOS_PAIRS:
        raise ValueError(f"a component of {n} vertices and {entries} entries of its factor is too large for {k} eigenvalues")
    shift = 1e-4
    while True:
        solve = _shifted_solver(i, j, blocks, shift)
        found, u = lanczos(lambda x: -shift * solve(x), n, k)
        values = -shift * (1 / found + 1)
        if k == 1 or shift / 30 < values[-1] < 300 * shift:
            return values, u
        shift = max(values[-1] / 30, 1e-12)


class Banded:
    """A connected graph's Laplacian L, its vertices in blocks with edges only within a block and to the next.

    Rows of vectors follow ``order``. Of a factor of L - shift, block LDL', only the inverses of D are kept.
    """

    def __init__(self, i: np.ndarray, j: np.ndarray, n: int, least: int = 32):
        blocks = _levels(i, j, n, least)
        self.n, self.order = n, np.concatenate(blocks)
        self.sizes = np.array([len(b) for b in blocks])
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.entries = int((self.sizes.astype(np.int64) ** 2).sum())
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)
        a, b = place[i], place[j]
        self.degree = np.bincount(a, minlength=n).astype(float)
        block = np.repeat(np.arange(len(blocks), dtype=np.int32), self.sizes)
        self.inside, self.back = [], []
        for found, keep in ((self.inside, block[a] == block[b]), (self.back, block[a] == block[b] + 1)):
            u, v = a[keep], b[keep]
            order = np.argsort(u, kind="stable")
            u, v = u[order], v[order]
            cuts = np.searchsorted(u, self.starts)
            u, v = u - self.starts[block[u]].astype(np.int32), v - self.starts[block[v]].astype(np.int32)
            found.extend((u[x:y], v[x:y]) for x, y in zip(cuts[:-1], cuts[1:]))

    def _low(self, t: int) -> np.ndarray:
        low = np.zeros((self.sizes[t], self.sizes[t - 1]), np.int8)
        low[self.back[t]] = -1
        return low

    def _pivots(self, shifts: np.ndarray):
        """Block after block the pivots of L - shift, stacked by shift, and the block's entries below the diagonal; takes the inverses."""
        low = inverse = None
        for t, m in enumerate(self.sizes):
            a = np.zeros((m, m))
            a[self.inside[t]] = -1.0
            a[np.arange(m), np.arange(m)] = self.degree[self.starts[t] : self.starts[t + 1]]
            s = a - shifts[:, None, None] * np.eye(m)
            if t:
                low = self._low(t)
                wide = low.astype(float)
                s -= wide @ inverse @ wide.T
                s = (s + s.transpose(0, 2, 1)) / 2
            inverse = yield s, low

    def count(self, shifts) -> np.ndarray:
        """How many eigenvalues lie below each shift: the negative ones of the pivots, by Sylvester's law of inertia."""
        shifts = np.asarray(shifts, float)
        out, steps = np.zeros(len(shifts), np.int64), self._pivots(shifts)
        inverse = None
        for _ in self.sizes:
            s, _ = steps.send(inverse)
            try:
                np.linalg.cholesky(s)
            except np.linalg.LinAlgError:
                out += (np.linalg.eigvalsh(s) < 0).sum(axis=1)
            inverse = np.linalg.inv(s)
        return out

    def solver(self, shift: complex):
        """b to the solution x of (L - shift) x = b; b has one column or more."""
        lows, inverses, steps, inverse = [], [], self._pivots(np.array([shift])), None
        for _ in self.sizes:
            s, low = steps.send(inverse)
            inverse = np.linalg.inv(s)
            lows.append(low)
            inverses.append(inverse[0])
        starts = self.starts

        def solve(b):
            x, part = np.empty(b.shape, np.result_type(b, shift)), None
            for t, inverse in enumerate(inverses):
                part = b[starts[t] : starts[t + 1]]
                x[starts[t] : starts[t + 1]] = after = inverse @ (part if t == 0 else part - lows[t] @ after)
            for t in range(len(inverses) - 2, -1, -1):
                x[starts[t] : starts[t + 1]] -= inverses[t] @ (lows[t + 1].T @ x[starts[t + 1] : starts[t + 2]])
            return x

        return solve


def _converged(product, n: int, rng, tolerance: float = 1e-10):
    """Ever more of the distinct eigenvalues, ascending, of a symmetric operator: Lanczos without a basis, in which copies of values found come up again."""
    q, before, size = rng.standard_normal(n), np.zeros(n), 0.0
    q /= np.linalg.norm(q)
    alpha, beta = [], []
    while True:
        w = product(q) - size * before
        alpha.append(float(q @ w))
        w -= alpha[-1] * q
        size = float(np.linalg.norm(w))
        if size < 1e-12 or len(alpha) % 32 == 0:
            ritz, s = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
            good = ritz[np.abs(s[-1]) * size < tolerance]
            yield good[np.diff(good, prepend=-np.inf) > 4 * tolerance]
        if size < 1e-12:
            return
        beta.append(size)
        before, q = q, w / size


def least_values(i: np.ndarray, j: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k least eigenvalues of a connected graph's Laplacian, for directed edges sorted by i.

    As ``least_pairs``, but without eigenvectors, so neither they nor a basis are held. Counts of the
    eigenvalues below a shift tell how often each value occurs and that none was missed.
    """
    band, k = Banded(i, j, n), min(k, n)
    if band.entries > FACTOR_ENTRIES:
        raise ValueError(f"a component of {n} vertices and {band.entries} entries of its factor is too large for {k} eigenvalues")
    shift, rng, known = 1e-4, np.random.default_rng(7), np.zeros(0)
    solve = band.solver(-shift)
    while True:
        seen = 0
        for found in _converged(lambda x: -shift * solve(x), n, rng):
            values = np.union1d(known, -shift * (1 / found + 1))
            # a value known from an earlier start, and what the tolerance of the operator is of each value
            width = 1e-9 * (values + shift) ** 2 / shift
            values, width = (x[np.diff(values, prepend=-np.inf) > width] for x in (values, width))
            seen, before = len(values), seen
            last = values[min(k, seen) - 1] if seen else 0.0
            if k > 1 and (seen > 8 and last > 300 * shift or seen > k and last < shift / 300):  # after the first few already
                shift, known = max(last / 30, 1e-12), np.zeros(0)
                solve = band.solver(-shift)
                break
            if seen > k and band.count([(values[k - 1] + values[k]) / 2])[0] == k:
                return values[:k]
            if seen > k or 0 < seen == before:  # none is missed below those whose numbers add up to the count
                below, upto = band.count(np.r_[values - width, values + width]).reshape(2, -1)
                times = upto - below
                if np.logical_and.accumulate(upto == np.cumsum(times)) @ times >= k:
                    return np.repeat(values, times)[:k]
        else:
            known = values


def _edges_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a component's vertices, ascending, and its edges, each given once, both ways by their places, sorted."""
    ids = np.unique(np.r_[u, v])
    u, v = np.searchsorted(ids, u), np.searchsorted(ids, v)
    both = np.r_[u * len(ids) + v, v * len(ids) + u]
    both.sort()
    return ids, (both // len(ids)).astype(np.int32), (both % len(ids)).astype(np.int32)


def _pairs_of(k: int | None, vectors: bool):
    def run(key, pdf):
        import pandas as pd

        ids, i, j = _edges_of(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        n = len(ids)
        if n <= DENSE_VERTICES:
            dense = np.zeros((n, n))
            dense[i, j] = -1.0
            dense[np.arange(n), np.arange(n)] = np.bincount(i, minlength=n)
            values, u = np.linalg.eigh(dense)
            values, u = values[:k], u[:, :k]
        elif k is None:
            raise ValueError(f"a component of {n} vertices is too large for all eigenvalues")
        elif not vectors:
            values = least_values(i, j, n, k)
        else:
            values, u = least_pairs(i, j, n, k)
        rows = {"component": key[0], "place": np.arange(len(values)), "value": values}
        rows["vertex_ids"] = [ids if vectors else None] * len(values)
        rows["vector"] = [u[:, c] for c in range(len(values))] if vectors else [None] * len(values)
        return pd.DataFrame(rows)

    return run


def _labelled(triangles: DataFrame, strategy: str = "auto") -> DataFrame:
    """``(component, u, v)``: the edges of the mesh, each once."""
    found = materialize(edges(triangles).select("u", "v").filter("u < v"), "edges")
    if strategy == "auto":
        strategy = "single" if found.count() <= LABEL_EDGES else "distributed"
    labels = components(found, strategy=strategy)
    return found.join(labels, found["u"] == labels["node"]).select("component", "u", "v")


def spectrum(triangles: DataFrame, k: int | None = None, vectors: bool = True, strategy: str = "auto") -> DataFrame:
    """``(component, place, value, vertex_ids, vector)``: eigenpairs of the graph Laplacian, of each component by ascending value.

    The matrix falls apart into the components of the mesh, each of which one task solves: densely
    up to ``DENSE_VERTICES`` vertices, beyond by Lanczos on an inverse, which finds up to ``LANCZOS_PAIRS``
    pairs, or any number of values, as long as the inverse's factor has at most ``FACTOR_ENTRIES`` entries; more is
    refused. ``k`` bounds the pairs of a component, so the k least of all are among them.
    """
    return _labelled(triangles, strategy).groupBy("component").applyInPandas(
        _pairs_of(k, vectors), "component long, place long, value double, vertex_ids array<long>, vector array<double>"
    )


def power_sums(triangles: DataFrame) -> DataFrame:
    """(s1, s2): sums of all eigenvalues of the graph Laplacian and of their squares.

    They are the matrix's trace and the sum of its squared entries, so no eigenvalue is computed.
    """
    rows = graph_laplacian(triangles)
    return rows.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("w"))).alias("s1"), F.sum(F.col("w") ** 2).alias("s2"))


def kernel(triangles: DataFrame, strategy: str = "auto") -> DataFrame:
    """(component, vertex_id, u): a basis of the eigenvectors to zero, which are constant on one component and zero elsewhere."""
    labels = materialize(components(edges(triangles), strategy=strategy), "kernel")
    sizes = labels.groupBy("component").agg(F.count("*").alias("rows"))
    sizes = sizes.select("component", (1 / F.sqrt("rows")).alias("u"), "rows")
    return join_groups(labels, sizes, ["component"]).select("component", F.col("node").alias("vertex_id"), "u")


def smallest_spectrum(triangles: DataFrame, k: int, vectors: bool = True) -> DataFrame:
    """The ``k`` least eigenpairs of the whole mesh, with ``rank`` from 0; ties by component."""
    least = spectrum(triangles, k, vectors).orderBy("value", "component", "place").limit(k)
    return least.withColumn("rank", F.row_number().over(Window.orderBy("value", "component", "place")) - 1)  # k rows


def partial_spectrum(triangles: DataFrame, share: float, vectors: bool = True) -> DataFrame:
    """The ``int(n * share)`` least eigenpairs, n the number of vertices with an edge."""
    n = degrees(triangles).count()
    k = int(n * share)
    if not 0 < k <= n:
        raise ValueError(f"{k} eigenvalues of {n}")
    return smallest_spectrum(triangles, k, vectors)


def low_pass(triangles: DataFrame, vertices: DataFrame, share: float, without: int | None = None) -> DataFrame:
    """Vertices projected on the smoothest eigenvectors; ``without`` leaves the one of that rank out.

    All eigenvectors span the whole space, so with none left out the vertices come back as they are.
    """
    if share == 1 and without is None:
        return vertices.select("vertex_id", "x", "y", "z").join(degrees(triangles).select("vertex_id"), "vertex_id", "left_semi")
    pairs = partial_spectrum(triangles, share)
    if without is not None:
        pairs = pairs.filter(F.col("rank") != without)
    pairs = materialize(pairs.select("rank", "vertex_ids", "vector"), "eigenvectors")
    entries = pairs.select("rank", F.explode(F.arrays_zip("vertex_ids", "vector")).alias("e")).select("rank", F.col("e.vertex_ids").alias("vertex_id"), F.col("e.vector").alias("u"))
    shares = entries.join(vertices, "vertex_id").groupBy("rank").agg(*[F.sum(F.col("u") * F.col(a)).alias(f"c{a}") for a in "xyz"])
    return entries.join(shares, "rank").groupBy("vertex_id").agg(*[F.sum(F.col("u") * F.col(f"c{a}")).alias(a) for a in "xyz"])


def scaled_sigmoid(values: DataFrame, column: str, shift: float = 0.5, gain: float = 20.0, quantile: float | None = None) -> DataFrame:
    """Min-max scaling, then a sigmoid about ``shift``, or about a quantile of the scaled values; a constant column gives zeros."""
    ends = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = values.crossJoin(F.broadcast(ends))
    scaled = scaled.withColumn("_s", F.coalesce(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)))
    if quantile is not None:
        mid = scaled.agg(F.percentile("_s", quantile).alias("_mid"))
        scaled = scaled.crossJoin(F.broadcast(mid))
        centre = F.col("_mid")
    else:
        centre = F.lit(float(shift))
    out = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.0)).otherwise(1 / (1 + F.exp(-gain * (F.col("_s") - centre))))
    return scaled.withColumn("scaled", out).drop("_lo", "_hi", "_s", "_mid")
