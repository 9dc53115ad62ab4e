"""Occupancy grids as ``cells(cx, cy, state)`` (0 free, 1 blocked, 2 start, 3 end) and paths through them."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.hulls import hull_sides
from lattica.session import discard, materialize

FREE, BLOCKED, START, END = 0, 1, 2, 3
STEPS8 = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
STEPS4 = [(-1, 0), (1, 0), (0, -1), (0, 1)]
STRAIGHT, DIAGONAL = 1000, 1414


def raster_bounds(hulls: DataFrame, start, end, detail: int) -> tuple[float, float, float, float]:
    """min x, max x, min y, max y of hulls, start and end, padded by one cell."""
    r = hulls.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    pad = 1 / detail
    xs, ys = [start[0], end[0], *[v for v in r[:2] if v is not None]], [start[1], end[1], *[v for v in r[2:] if v is not None]]
    return min(xs) - pad, max(xs) + pad, min(ys) - pad, max(ys) + pad


def raster_hulls(hulls: DataFrame, start, end, detail: int) -> DataFrame:
    """(cx, cy, state) of the cells that are not free.

    A cell is blocked if a corner of it lies in a hull (closed). Each hull is compared with the
    grid corners of its own box only, and a blocked corner blocks its up to four cells.
    """
    x0, x1, y0, y1 = raster_bounds(hulls, start, end, detail)
    w, h = int((x1 - x0) * detail), int((y1 - y0) * detail)
    sx, sy = (x1 - x0) / w, (y1 - y0) / h
    boxes = hulls.groupBy("region_id").agg(F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1"))
    span = lambda lo, hi, origin, step: F.sequence(F.floor((F.col(lo) - origin) / step), F.ceil((F.col(hi) - origin) / step))
    spots = boxes.select("region_id", F.explode(span("bx0", "bx1", x0, sx)).alias("i"), "by0", "by1")
    spots = spots.select("region_id", "i", F.explode(span("by0", "by1", y0, sy)).alias("j"))
    px, py = F.lit(x0) + F.col("i") * sx, F.lit(y0) + F.col("j") * sy
    turn = (F.col("nx") - F.col("x")) * (py - F.col("y")) - (F.col("ny") - F.col("y")) * (px - F.col("x"))
    hit = spots.join(hull_sides(hulls).hint("merge"), "region_id").groupBy("region_id", "i", "j").agg(F.min(turn).alias("least")).filter("least >= 0")
    around = F.array(*[F.struct((F.col("i") + di).alias("cx"), (F.col("j") + dj).alias("cy")) for di in (-1, 0) for dj in (-1, 0)])
    blocked = hit.select(F.explode(around).alias("c")).select("c.cx", "c.cy").filter(f"cx >= 0 AND cx < {w} AND cy >= 0 AND cy < {h}").distinct()
    ends = [(_cell(start, (x0, x1, y0, y1), w, h), START), (_cell(end, (x0, x1, y0, y1), w, h), END)]
    marks = hulls.sparkSession.createDataFrame([(c[0], c[1], s) for c, s in ends], "cx long, cy long, state int")
    marks = marks.groupBy("cx", "cy").agg(F.max("state").alias("state"))
    return blocked.withColumn("state", F.lit(BLOCKED)).join(marks.select("cx", "cy"), ["cx", "cy"], "left_anti").unionByName(marks)


def full_raster(hulls: DataFrame, start, end, detail: int) -> tuple[DataFrame, int, int]:
    """(cells, width, height): ``raster_hulls`` with a row for every cell of the grid."""
    x0, x1, y0, y1 = raster_bounds(hulls, start, end, detail)
    w, h = int((x1 - x0) * detail), int((y1 - y0) * detail)
    every = hulls.sparkSession.range(w * h).select((F.col("id") % w).alias("cx"), F.floor(F.col("id") / w).alias("cy"))
    marked = raster_hulls(hulls, start, end, detail)
    return every.join(marked, ["cx", "cy"], "full").select("cx", "cy", F.coalesce("state", F.lit(FREE)).alias("state")), w, h


def _cell(p, bounds, w, h) -> tuple[int, int]:
    x0, x1, y0, y1 = bounds
    return round((p[0] - x0) * w / (x1 - x0)), round((p[1] - y0) * h / (y1 - y0))


def raster_points(points: DataFrame, half_x: int, half_y: int, width: int, height: int) -> DataFrame:
    """(cx, cy, state 1): each pixel ``points(px, py)`` as a filled rectangle, clipped to the image."""
    seq = lambda c, half, n: F.sequence(F.greatest(F.col(c) - half, F.lit(0)), F.least(F.col(c) + half, F.lit(n - 1)))
    inside = points.select("px", "py").distinct().filter(f"px + {half_x} >= 0 AND px - {half_x} < {width} AND py + {half_y} >= 0 AND py - {half_y} < {height}")
    rows = inside.withColumn("cx", F.explode(seq("px", half_x, width))).withColumn("cy", F.explode(seq("py", half_y, height)))
    return rows.select("cx", "cy").distinct().withColumn("state", F.lit(BLOCKED))


def paint(cells: DataFrame, path: DataFrame, state: int) -> DataFrame:
    """``cells`` with the cells of ``path(cx, cy)`` set to ``state``; cells absent so far are added."""
    marked = path.select("cx", "cy").distinct().withColumn("new", F.lit(state))
    return cells.join(marked, ["cx", "cy"], "full").select("cx", "cy", F.coalesce("new", "state").alias("state"))


def clamp(px, py, width: int, height: int):
    """Columns moved into the image."""
    return F.least(F.greatest(px, F.lit(0)), F.lit(width - 1)), F.least(F.greatest(py, F.lit(0)), F.lit(height - 1))


def _costs(diagonal: bool, straight: int, slanted: int):
    return [(dx, dy, slanted if dx and dy else straight) for dx, dy in (STEPS8 if diagonal else STEPS4)]


def distances(cells: DataFrame, start: tuple[int, int], diagonal: bool = True, straight: int = 1, slanted: int = 1, bound: int | None = None) -> DataFrame:
    """(cx, cy, dist): least cost from ``start`` over cells that are not blocked.

    Waves of relaxation: the frontier's neighbours improve on the distances so far. One cell has one
    row, each wave is one join, written to the shared folder every round; the number of waves is
    that of the longest cheapest path. ``bound`` stops at that many waves.
    """
    open_cells = materialize(cells.filter(F.col("state") != BLOCKED).select("cx", "cy"), "open")
    spark = cells.sparkSession
    here = spark.createDataFrame([(*start, 0)], "cx long, cy long, dist long")
    known = materialize(open_cells.join(here, ["cx", "cy"]).select("cx", "cy", "dist"), "dist")
    front, wave = known, 0
    moves = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(m, ("dx", "dy", "c"))]) for m in _costs(diagonal, straight, slanted)])
    while bound is None or wave < bound:
        wave += 1
        reach = front.select("cx", "cy", "dist", F.explode(moves).alias("m"))
        reach = reach.groupBy((F.col("cx") + F.col("m.dx")).alias("cx"), (F.col("cy") + F.col("m.dy")).alias("cy")).agg(F.min(F.col("dist") + F.col("m.c")).alias("new"))
        better = reach.join(open_cells, ["cx", "cy"]).join(known, ["cx", "cy"], "left").filter("dist IS NULL OR new < dist")
        better = materialize(better.select("cx", "cy", F.col("new").alias("dist")), "wave")
        if better.isEmpty():
            break
        merged = materialize(known.join(better.select("cx", "cy"), ["cx", "cy"], "left_anti").unionByName(better), "dist")
        if front is not known:
            discard(front)
        discard(known)
        known, front = merged, better
    return known


def _dijkstra(start, moves):
    def run(batches):
        import pyarrow as pa

        open_cells = set()
        for batch in batches:
            open_cells.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        best, heap = {start: 0} if start in open_cells else {}, [(0, start)]
        while heap and best:
            d, c = heapq.heappop(heap)
            if d > best[c]:
                continue
            for dx, dy, cost in moves:
                n = (c[0] + dx, c[1] + dy)
                if n in open_cells and d + cost < best.get(n, math.inf):
                    best[n] = d + cost
                    heapq.heappush(heap, (d + cost, n))
        cols = list(zip(*[(x, y, d) for (x, y), d in best.items()])) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cx", "cy", "dist"])

    return run


#: Up to this many cells one task's heap is quicker than a job for each wave.
SINGLE_TASK_CELLS = 5_000_000


def shortest(cells: DataFrame, start: tuple[int, int], diagonal: bool = True, straight: int = 1, slanted: int = 1, strategy: str = "auto") -> DataFrame:
    """``distances`` by one task up to ``SINGLE_TASK_CELLS`` cells, by waves beyond; both return the same rows."""
    if strategy == "auto":
        strategy = "single" if cells.count() <= SINGLE_TASK_CELLS else "waves"
    if strategy == "waves":
        return distances(cells, start, diagonal, straight, slanted)
    free = cells.filter(F.col("state") != BLOCKED).select(F.col("cx").cast("long"), F.col("cy").cast("long")).repartition(1)
    return free.mapInArrow(_dijkstra(start, _costs(diagonal, straight, slanted)), "cx long, cy long, dist long")


def path_cells(dist: DataFrame, end: tuple[int, int], diagonal: bool = True, straight: int = 1, slanted: int = 1) -> DataFrame:
    """(step, cx, cy) from start to end, back along the parent of least (dist, cx, cy); empty if there is no path.

    Parents come from one self-join of the whole grid, shuffled, as its table is small on disk only;
    the walk then reads one row a step.
    """
    moves = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(m, ("dx", "dy", "c"))]) for m in _costs(diagonal, straight, slanted)])
    toward = dist.select("cx", "cy", "dist", F.explode(moves).alias("m")).select(
        "cx", "cy", "dist", (F.col("cx") - F.col("m.dx")).alias("px"), (F.col("cy") - F.col("m.dy")).alias("py"), (F.col("dist") - F.col("m.c")).alias("pd")
    )
    prior = dist.select(F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("dist").alias("pd"))
    parents = toward.join(prior.hint("merge"), ["px", "py", "pd"]).groupBy("cx", "cy", "dist").agg(F.min(F.struct("pd", "px", "py")).alias("p"))
    parents = dist.join(parents.select("cx", "cy", "p").hint("merge"), ["cx", "cy"], "left").select("cx", "cy", "dist", "p.px", "p.py")

    def walk(batches):
        import pyarrow as pa

        back = {}
        for batch in batches:
            for cx, cy, _, px, py in zip(*[c.to_pylist() for c in batch.columns]):
                back[(cx, cy)] = None if px is None else (px, py)
        path, at = [], end if end in back else None
        while at is not None:
            path.append(at)
            at = back[at]
        path.reverse()
        xs, ys = [p[0] for p in path], [p[1] for p in path]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (range(len(path)), xs, ys)], names=["step", "cx", "cy"])

    return parents.repartition(1).mapInArrow(walk, "step long, cx long, cy long")


def _faithful(start, end, diagonal_cost):
    def run(batches):
        import pyarrow as pa

        blocked, w, h = set(), 0, 0
        for batch in batches:
            for cx, cy, s in zip(*[c.to_pylist() for c in batch.columns]):
                w, h = max(w, cx + 1), max(h, cy + 1)
                if s == BLOCKED:
                    blocked.add((cx, cy))
        guess = lambda c: math.hypot(c[0] - end[0], c[1] - end[1])
        cost, came, heap = {start: 0.0}, {}, [(guess(start), start)]
        found = False
        while heap:
            _, c = heapq.heappop(heap)
            if c == end:
                found = True
                break
            for dx, dy in STEPS8:
                n = (c[0] + dx, c[1] + dy)
                if not (0 <= n[0] < w and 0 <= n[1] < h) or n in blocked:
                    continue
                new = cost[c] + (diagonal_cost if dx and dy else 1)
                if new < cost.get(n, math.inf):
                    cost[n], came[n] = new, c
                    heapq.heappush(heap, (new + guess(n), n))
        path = []
        if found:
            path = [end]
            while path[-1] in came:
                path.append(came[path[-1]])
            path.reverse()
        xs, ys = [p[0] for p in path], [p[1] for p in path]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (range(len(path)), xs, ys)], names=["step", "cx", "cy"])

    return run


def astar_faithful(cells: DataFrame, start: tuple[int, int], end: tuple[int, int], diagonal_cost: float = 1.0) -> DataFrame:
    """A* with the straight-line guess, which exceeds the cost of diagonal steps, so its path may not be shortest."""
    grid = cells.select(F.col("cx").cast("long"), F.col("cy").cast("long"), "state").repartition(1)
    return grid.mapInArrow(_faithful(start, end, diagonal_cost), "step long, cx long, cy long")


def cached_raster(spark: SparkSession, folder: str, hulls: DataFrame, start, end, detail: int) -> DataFrame:
    """``raster_hulls`` kept as parquet under a hash of everything it depends on."""
    key = hulls.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(",", "region_id", "seq", "x", "y")))), 256)).first()[0]
    import hashlib

    name = hashlib.sha256(repr((key, tuple(start), tuple(end), detail)).encode()).hexdigest()[:32]
    path = f"{folder}/grid-{name}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        raster_hulls(hulls, start, end, detail).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
