"""Near-duplicate vectors by collision counting on one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import components, cut, forest

#: Projections, and rows of a tile at most.
PROJECTIONS, TILE = 24, 1024
#: Projections that are counted for all pairs of a tile.
FIRST_LINES = 12
#: Half-width of a window in standard deviations of the difference of two vectors at the threshold.
WIDTH = 3.0
#: The chance that a pair at the threshold is missed, by which the collision count is calibrated.
MISS = 1e-6
SEED = 20_240_601


def calibrated_count(projections: int, p: float, miss: float) -> int:
    """The largest count that a pair with collision rate p reaches but with probability miss."""
    below = 0.0
    for n in range(projections + 1):
        below += math.comb(projections, n) * p**n * (1 - p) ** (projections - n)
        if below > miss:
            return n
    return projections


def _directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, n))


def _unit(values) -> np.ndarray | None:
    """A vector scaled to length 1 in double precision; None if it can't be."""
    if values is None or len(values) == 0:
        return None
    if isinstance(values, np.ndarray) and values.dtype != object:
        x = values.astype(np.float64)
    elif any(v is None for v in values):
        return None
    else:
        x = np.array(values, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    most = np.abs(x).max()
    if most == 0:
        return None
    x = x / most
    return x / math.sqrt(float(x @ x))


def _prepare(cell: float):
    """Unit vectors with the cells that their first two projections fall in."""
    def run(batches):
        for pdf in batches:
            rows = []
            for v in pdf["v"]:
                x = _unit(v)
                a, b = (np.floor(x @ _directions(len(x), PROJECTIONS)[:, :2] / cell).astype(int) if x is not None else (0, 0))
                rows.append((0 if x is None else len(x), int(a), int(b), None if x is None else x.tobytes()))
            yield pd.concat([pdf.drop(columns="v"), pd.DataFrame(rows, columns=["dim", "a", "b", "unit"], index=pdf.index)], axis=1)

    return run


def _collisions(rows: np.ndarray, cols: np.ndarray, width: float, count: int, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of projected vectors that fall into each other's windows on count of the sorted lines at least.
    The first lines leave few pairs that can still get there, and the others are counted for these alone. With
    upper, rows and columns are the same vectors, and only pairs with the row first are taken."""
    lines = rows.shape[1]
    hits, place = np.zeros((len(rows), len(cols)), dtype=np.int8), np.empty(len(cols), dtype=np.int32)
    i = j = seen = np.empty(0, dtype=np.int64)
    for k in range(lines):
        order = np.argsort(cols[:, k], kind="stable")
        place[order] = np.arange(len(cols), dtype=np.int32)
        line = cols[order, k]
        lo, hi = (np.searchsorted(line, rows[:, k] + d, side).astype(np.int32) for d, side in ((-width, "left"), (width, "right")))
        if k < FIRST_LINES:
            hits += (place >= lo[:, None]) & (place < hi[:, None])
        else:
            seen = seen + ((place[j] >= lo[i]) & (place[j] < hi[i]))
        if k == FIRST_LINES - 1:
            possible = hits >= count - (lines - FIRST_LINES)
            i, j = np.nonzero(np.triu(possible, 1) if upper else possible)
            seen = hits[i, j].astype(np.int64)
        elif k >= FIRST_LINES:
            keep = seen >= count - (lines - 1 - k)
            i, j, seen = i[keep], j[keep], seen[keep]
    return i, j


def _collide(threshold: float, width: float, count: int):
    """Links within a tile or between two: rows of a tile pair give their links' weights and a spanning forest."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        pdf = pdf.sort_values(["side", "id", "k1", "k2"], kind="stable")
        x = np.frombuffer(b"".join(pdf["unit"]), dtype=np.float64).reshape(len(pdf), dim)
        side, ids, mult = pdf["side"].to_numpy(), pdf["id"].to_numpy(), pdf["mult"].to_numpy()
        alone = not (side == 1).any()
        rows, cols = (np.arange(len(pdf)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if not len(rows) or not len(cols):
            return pd.DataFrame({"k1": [], "k2": [], "weight": [], "id": [], "other": []})
        proj = x @ _directions(dim, PROJECTIONS)
        i, j = _collisions(proj[rows], proj[cols], width, count, alone)
        i, j = rows[i], cols[j]
        near = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.empty(0)]) >= threshold
        i, j = i[near], j[near]
        weight = np.bincount(i, mult[j], len(pdf)) + np.bincount(j, mult[i], len(pdf))
        linked = np.flatnonzero(weight)
        node, root = forest(ids[i], ids[j]) if len(i) else (np.empty(0, np.int64), np.empty(0, np.int64))
        other = dict(zip(node.tolist(), root.tolist(), strict=True))
        found = pdf.iloc[linked]
        return pd.DataFrame({"k1": found["k1"], "k2": found["k2"], "weight": weight[linked].astype(np.int64), "id": found["id"], "other": [other.get(n, n) for n in ids[linked].tolist()]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id for every row; vectors of equal label with cosine >= threshold are linked.

    Equal vectors of a label become one representative that stands for all of them. Representatives are dealt to
    cells by label and two projections, wide enough that a pair at the threshold lies in the same or neighbouring
    cells but for a chance below miss; cells are split by hash into tiles of at most about TILE rows, and each
    pair of tiles is one group. There all projections are sorted, collisions in the window around each
    vector are counted per pair, and pairs whose count reaches the calibrated one are verified by their cosine. A
    tile pair passes on sums and a spanning forest, never its pairs.

    Null or empty vectors, vectors of zeros or with null or non-finite components, and null labels link with
    nothing: n_links 0, their own component. Rows with a null id count as links of others only through equal
    vectors and have a null component. Rows that repeat an id keep their own n_links, that of their vector; for
    components they are one node, which has the links of all their vectors. Vectors of different lengths never
    link. Extra columns are ignored. An empty table gives no rows.
    """
    sigma = math.sqrt(max(0.0, 2 - 2 * threshold))
    width = WIDTH * sigma + 1e-9
    p = math.erf(WIDTH / math.sqrt(2))
    count = calibrated_count(PROJECTIONS, p, miss)
    cell = 5.2 * sigma + 1e-9
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    text = F.col("v").cast("string")
    rows = rows.withColumn("k1", F.xxhash64("label", "v")).withColumn("k2", F.xxhash64(text, "label"))
    usable = rows.filter("label is not null and id is not null and v is not null")
    reps = usable.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("v").alias("v"))
    members = cut(rows.select("id", F.when(F.col("label").isNotNull() & F.col("v").isNotNull(), F.col("k1")).alias("k1"), "k2"))
    reps = cut(reps)
    units = cut(reps.mapInPandas(_prepare(cell), "k1 long, k2 long, id long, mult long, label string, dim int, a long, b long, unit binary").filter("unit is not null"))
    cells = units.groupBy("label", "dim", "a", "b").agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE))
    cells = cut(cells.drop("n"))
    tiles = cells.withColumn("t", F.explode(F.sequence(F.lit(1), F.col("tiles")))).drop("tiles")
    # each pair of tiles in the same or neighbouring cells once; a tile with itself has one side
    step = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    left = tiles.withColumn("d", F.explode(step)).select("label", "dim", "a", "b", F.col("t").alias("t0"), (F.col("a") + F.col("d.x")).alias("a1"), (F.col("b") + F.col("d.y")).alias("b1"))
    right = tiles.select("label", "dim", F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("t").alias("t1"))
    pairs = left.join(right, ["label", "dim", "a1", "b1"]).filter("a <> a1 or b <> b1 or t0 <= t1").withColumn("pair", F.xxhash64("label", "dim", "a", "b", "t0", "a1", "b1", "t1"))
    sides = pairs.select("pair", "label", "dim", "a", "b", F.col("t0").alias("t"), F.lit(0).alias("side")).unionByName(
        pairs.filter("a <> a1 or b <> b1 or t0 <> t1").select("pair", "label", "dim", F.col("a1").alias("a"), F.col("b1").alias("b"), F.col("t1").alias("t"), F.lit(1).alias("side")))
    placed = units.join(cells, ["label", "dim", "a", "b"]).withColumn("t", F.pmod(F.xxhash64("k1"), F.col("tiles")) + 1)
    dealt = placed.join(sides, ["label", "dim", "a", "b", "t"]).select("pair", "side", "k1", "k2", "id", "mult", "dim", "unit")
    found = cut(dealt.groupBy("pair").applyInPandas(_collide(threshold, width, count), "k1 long, k2 long, weight long, id long, other long"))
    weights = found.groupBy("k1", "k2").agg(F.sum("weight").alias("weight"))
    # an id that has several vectors is linked with the representatives of them all
    valid = members.filter("k1 is not null and id is not null").join(units.select("k1", "k2", F.col("id").alias("rep")), ["k1", "k2"])
    several = valid.groupBy("id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low <> high").select("id")
    own = valid.join(several, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    links = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(own)).withColumnRenamed("id", "rep")
    of_rep = units.select("k1", "k2", F.col("id").alias("rep"), "mult").join(weights, ["k1", "k2"], "left").join(links, "rep", "left")
    of_rep = of_rep.select("k1", "k2", (F.col("mult") - 1 + F.coalesce("weight", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("c"))
    out = members.join(of_rep, ["k1", "k2"], "left").select(F.col("id").alias("vec_id"), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
