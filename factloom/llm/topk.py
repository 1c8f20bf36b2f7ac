"""Exact top-k inner products by dual-tree search over cover trees of queries and data."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

#: Rows of a data block and of a query group, at most on average; vectors that the cells are built around.
BLOCK, GROUP, PIVOTS = 4096, 512, 24
#: Rows of a leaf of a data tree and of a query tree, and children of a node.
LEAF, QUERY_LEAF, CHILDREN = 256, 64, 16
EXACT = 2.0**53


class CoverTree:
    """Nodes cover their rows by a ball around one of them. Children's centres are picked farthest first, so that
    they are as far apart as the node's radius allows, and each row goes to its nearest centre. Equal rows end in
    one leaf, of radius 0, whatever their number."""

    def __init__(self, x: np.ndarray, leaf: int) -> None:
        self.x, self.leaf = x, leaf
        self.norms = np.einsum("ij,ij->i", x, x)
        self.nodes: list[tuple[np.ndarray, float, float, np.ndarray | None, list[int]]] = []  # centre, its norm, radius, rows of a leaf, children
        self._build(np.arange(len(x)), 0)

    def _far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        d = self.norms[rows] - 2 * (self.x[rows] @ self.x[centre]) + self.norms[centre]
        return np.sqrt(np.maximum(d, 0))

    def _build(self, rows: np.ndarray, centre: int) -> int:
        far = self._far(rows, centre)
        radius, at = float(far.max(initial=0.0)), len(self.nodes)
        self.nodes.append((self.x[centre], float(np.sqrt(self.norms[centre])), radius, rows, []))
        if len(rows) <= self.leaf or radius <= 1e-9 * (1 + float(np.sqrt(self.norms[rows].max()))):
            return at
        centres, owner, best = [centre], np.zeros(len(rows), dtype=int), far
        while len(centres) < CHILDREN and best.max() > radius / 2:
            centres.append(int(rows[best.argmax()]))
            d = self._far(rows, centres[-1])
            owner[d < best] = len(centres) - 1
            best = np.minimum(best, d)
        own = [self._build(rows[owner == i], c) for i, c in enumerate(centres) if (owner == i).any()]
        self.nodes[at] = (*self.nodes[at][:3], None, own)
        return at


def bound(q: tuple, d: tuple) -> float:
    """No inner product of rows of two nodes is above this."""
    return float(q[0] @ d[0]) + q[1] * d[2] + d[1] * q[2] + q[2] * d[2]


class Group:
    """Queries of a group with their k best so far. floors are scores that k rows are already known to reach."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floors: np.ndarray) -> None:
        self.ids, self.x, self.k, self.floors = ids, x, k, floors
        self.tree = CoverTree(x, QUERY_LEAF)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def worst(self, node: int) -> float:
        _, _, _, rows, children = self.tree.nodes[node]
        if rows is None:
            return min(self.worst(c) for c in children)
        return float(np.maximum(self.scores[rows, -1], self.floors[rows]).min())

    def meet(self, rows: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        """Score queries against data rows; ties go to the smaller id."""
        s = self.x[rows] @ y.T
        s[self.ids[rows][:, None] == ids[None, :]] = -np.inf
        s = np.hstack([self.scores[rows], s])
        n = np.hstack([self.found[rows], np.broadcast_to(ids, (len(rows), len(ids)))])
        edge = np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k]
        for at, r in enumerate(rows):
            near = np.flatnonzero(s[at] >= edge[at])
            best = near[np.lexsort((n[at, near], -s[at, near]))[: self.k]]
            self.scores[r], self.found[r] = s[at, best], n[at, best]

    def search(self, ids: np.ndarray, data: CoverTree) -> None:
        """Node pairs by falling bound; a pair goes once its bound is under the worst k-th score of its queries."""
        q0, d0 = self.tree.nodes[0], data.nodes[0]
        todo = [(-bound(q0, d0), 0, 0)]
        while todo:
            high, q, d = heapq.heappop(todo)
            if -high * (1 + 1e-12 * np.sign(-high)) + 1e-6 < self.worst(q):
                continue
            qn, dn = self.tree.nodes[q], data.nodes[d]
            if qn[3] is not None and dn[3] is not None:
                self.meet(qn[3], ids[dn[3]], data.x[dn[3]])
            elif dn[3] is None and (qn[3] is not None or dn[2] >= qn[2]):
                for c in dn[4]:
                    heapq.heappush(todo, (-bound(qn, data.nodes[c]), q, c))
            else:
                for c in qn[4]:
                    heapq.heappush(todo, (-bound(self.tree.nodes[c], dn), c, d))

    def rows(self) -> pd.DataFrame:
        n, at = np.nonzero(np.isfinite(self.scores))
        return pd.DataFrame({"query_id": self.ids[n], "vec_id": self.found[n, at], "score": self.scores[n, at].astype(np.int64)})


def _slow(q: pd.DataFrame, d: pd.DataFrame, k: int) -> pd.DataFrame:
    """Python integers, for components too large for exact floating point; scores are held to the range of long."""
    out = []
    data = [(int(i), [int(v) for v in np.frombuffer(b)]) for i, b in zip(d["id"], d["vec"], strict=True)]
    for i, b in zip(q["id"], q["vec"], strict=True):
        x = [int(v) for v in np.frombuffer(b)]
        scored = sorted((-sum(a * c for a, c in zip(x, y, strict=True)), j) for j, y in data if j != i)[:k]
        out += [(int(i), j, max(-(2**63), min(2**63 - 1, -s))) for s, j in scored]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["vec"]), dtype=np.float64).reshape(len(pdf), -1)


def _evaluate(k: int):
    """Rows sorted by block, data before queries, queries by group: a tree is built for a block once."""
    def run(batches):
        block, held, data, ids = None, [], None, None
        current = None

        def close():
            nonlocal data, ids, held
            if not held:
                return None
            pdf, held = pd.concat(held), []
            if pdf["side"].iloc[0] == 0:
                ids, data = pdf["id"].to_numpy(), (CoverTree(_matrix(pdf), LEAF), pdf)
                return None
            if data is None:
                return None
            x = _matrix(pdf)
            if np.abs(x).max(initial=0) * np.abs(data[0].x).max(initial=0) * x.shape[1] >= EXACT:
                return _slow(pdf, data[1], k)
            group = Group(pdf["id"].to_numpy(), x, k, pdf["floor"].to_numpy(float))
            group.search(ids, data[0])
            return group.rows()

        for batch in batches:
            keys = batch[["block", "side", "grp"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for part in np.split(np.arange(len(batch)), cuts):
                if not len(part):
                    continue
                key = tuple(keys[part[0]].tolist())
                if key != current:
                    if (out := close()) is not None:
                        yield out
                    if key[0] != block:
                        block, data = key[0], None
                    current = key
                held.append(batch.iloc[part])
        if (out := close()) is not None:
            yield out

    return run


def _integers(batches):
    """floor(256 x) of each vector that takes part, as doubles, which hold these integers exactly."""
    for pdf in batches:
        rows = []
        for i, v in zip(pdf["id"], pdf["v"], strict=True):
            if v is None or len(v) == 0 or (getattr(v, "dtype", None) == object and any(c is None for c in v)):
                continue
            with np.errstate(over="ignore"):
                x = np.floor(256 * np.asarray(v, dtype=np.float64))
            if np.isfinite(x).all():
                rows.append((i, len(x), x.tobytes()))
        yield pd.DataFrame(rows, columns=["id", "dim", "vec"])


def _cells(pivots: dict[int, np.ndarray]):
    def run(batches):
        for pdf in batches:
            cell = []
            for dim, vec in zip(pdf["dim"], pdf["vec"], strict=True):
                p = pivots[dim]
                cell.append(int(((p - np.frombuffer(vec)) ** 2).sum(axis=1).argmin()))
            yield pdf.assign(cell=cell)

    return run


def _ball(pdf: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(pdf)
    centre = x.mean(axis=0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
    floor = float(pdf["floor"].min()) if "floor" in pdf else 0.0
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "dim": [x.shape[1]], "centre": [centre.tolist()], "norm": [float(np.sqrt(centre @ centre))], "radius": [radius], "floor": [floor]})


_BALL = "key long, dim long, centre array<double>, norm double, radius double, floor double"


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k rows of highest inner
    product of floor(256 x), ties to the smaller id, among all rows but those of its own id.

    Rows are dealt to cells around a bounded number of pivots and cells are split by hash into blocks and query
    groups of bounded size. Each group first meets the blocks of its own cell, which gives every query a floor;
    then it meets the other blocks whose ball could still hold a better row. A task builds a block's tree once and
    streams the groups past it, both trees pruned together. Vectors that are null, empty or hold null or non-finite
    components, and rows without an id, take no part; vectors of different lengths never meet. Rows that repeat
    an id are candidates one by one. With fewer than k candidates all are returned. Extra columns are ignored.
    """
    ints = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInPandas(_integers, "id long, dim long, vec binary")
    ints = cut(ints)
    top = ints.withColumn("n", F.row_number().over(Window.partitionBy("dim", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.xxhash64("id", "vec")))).filter("n = 1")
    chosen = top.groupBy("dim").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("vec").alias("h"), "vec"))), 1, PIVOTS).alias("p")).collect()  # PIVOTS rows for each length
    pivots = {r["dim"]: np.vstack([np.frombuffer(x["vec"]) for x in r["p"]]) for r in chosen}
    placed = cut(ints.mapInPandas(_cells(pivots), "id long, dim long, vec binary, cell int"))
    is_query = F.col("id") % every == 0
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.count_if(is_query) / GROUP).alias("groups"))
    placed = placed.join(sizes, ["dim", "cell"])
    block = placed.withColumn("block", F.xxhash64("dim", "cell", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))).select("block", "dim", "cell", "id", "vec")
    group = placed.filter(is_query).withColumn("grp", F.xxhash64("dim", "cell", F.pmod(F.xxhash64("id", F.lit(2)), F.col("groups")))).select("grp", "dim", "cell", "id", "vec")
    block, group = cut(block), cut(group)

    def meet(pairs: DataFrame, floors: DataFrame | None) -> DataFrame:
        """Results for pairs (grp, block); a block without a group isn't read into a tree."""
        queries = group.withColumn("floor", F.lit(float("-inf"))) if floors is None else group.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        queries = pairs.join(queries, "grp").select("block", F.lit(1).alias("side"), "grp", "id", "vec", "floor")
        data = block.join(pairs.select("block").distinct(), "block", "left_semi").select("block", F.lit(0).alias("side"), F.lit(0).cast("long").alias("grp"), "id", "vec", F.lit(0.0).alias("floor"))
        dealt = data.unionByName(queries).repartition("block").sortWithinPartitions("block", "side", "grp", "id")
        return dealt.mapInPandas(_evaluate(k), "query_id long, vec_id long, score long")

    home = cut(group.select("grp", "dim", "cell").distinct().join(block.select("block", "dim", "cell").distinct(), ["dim", "cell"]).select("grp", "block"))
    first = cut(meet(home, None))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = cut(first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor")))
    blocks = block.select(F.col("block").alias("key"), "vec").groupBy("key").applyInPandas(_ball, _BALL)
    groups = group.join(floors, "id", "left").select(F.col("grp").alias("key"), "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")).groupBy("key").applyInPandas(_ball, _BALL)
    b, g = cut(blocks.select(*[F.col(c).alias(f"b_{c}") for c in blocks.columns])), cut(groups.select(*[F.col(c).alias(f"g_{c}") for c in groups.columns]))
    dot = F.aggregate(F.zip_with("b_centre", "g_centre", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    upper = dot + F.col("b_norm") * F.col("g_radius") + F.col("g_norm") * F.col("b_radius") + F.col("b_radius") * F.col("g_radius")
    pairs = g.join(b, g.g_dim == b.b_dim).filter(upper * (1 + 1e-9 * F.signum(upper)) + 1e-6 >= F.col("g_floor")).select(F.col("g_key").alias("grp"), F.col("b_key").alias("block"))  # balls, not rows
    rest = cut(pairs.join(home, ["grp", "block"], "left_anti"))
    found = first.unionByName(meet(rest, floors)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
