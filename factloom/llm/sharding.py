"""Sharding by Karmarkar-Karp differencing: indivisible groups of equal texts, shards of near equal bytes."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

#: Items that one task differences at a time.
CELL = 4096
PLACED = "h long, crc long, size long, bytes long, bits int, item long, part int"


def differencing(items: list[list[int]], shards: int) -> list[list[int]]:
    """Combine partial partitions until one is left. items[i][s] is the size of part s of item i, and the result
    [i][s] the shard that this part goes to.

    The two partial partitions of largest spread (most minus least) are combined again and again, the largest
    part of one with the smallest of the other.
    """
    heap, made = [], []
    for i, sizes in enumerate(items):
        order = sorted(range(shards), key=lambda s: -sizes[s])
        ordered = [sizes[s] for s in order]
        made.append((None, i, order))
        heap.append((ordered[-1] - ordered[0], i, ordered))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, x, a = heapq.heappop(heap)
        _, y, b = heapq.heappop(heap)
        both = [p + q for p, q in zip(a, reversed(b), strict=True)]
        order = sorted(range(shards), key=lambda s: -both[s])
        ordered = [both[s] for s in order]
        made.append((x, y, order))
        heapq.heappush(heap, (ordered[-1] - ordered[0], len(made) - 1, ordered))
    out: list[list[int]] = [[] for _ in items]
    todo = [(len(made) - 1, list(range(shards)))] if items else []
    while todo:
        node, to = todo.pop()
        x, y, order = made[node]
        if x is None:
            placed = [0] * shards
            for at, s in enumerate(order):
                placed[s] = to[at]
            out[y] = placed
        else:
            left, right = [0] * shards, [0] * shards
            for at, s in enumerate(order):
                left[s] = right[shards - 1 - s] = to[at]
            todo += [(x, left), (y, right)]
    return out


def _groups_of_cell(shards: int, ahead: list[int], left: int):
    """Difference a cell's groups. Where some shards are ahead, the cell starts from its share of that, by its bytes of
    those left, as one more partial partition, whose parts then name the shards."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "h", "crc", "size"], ascending=False).reset_index(drop=True)
        sizes = pdf["bytes"].tolist()
        items = [[n] + [0] * (shards - 1) for n in sizes]
        if not ahead:
            return pdf.assign(part=[p[0] for p in differencing(items, shards)])
        placed = differencing([[x * sum(sizes) // left for x in ahead], *items], shards)
        shard_at = {at: s for s, at in enumerate(placed[0])}
        return pdf.assign(part=[shard_at[p[0]] for p in placed[1:]])

    return run


def _cells_of_cell(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf["item"].unique().tolist())
        at = {x: i for i, x in enumerate(ids)}
        sizes = [[0] * shards for _ in ids]
        for item, part, n in zip(pdf["item"].tolist(), pdf["part"].tolist(), pdf["bytes"].tolist(), strict=True):
            sizes[at[item]][part] += n
        placed = differencing(sizes, shards)
        return pd.DataFrame([(x, s, placed[at[x]][s]) for x in ids for s in range(shards)], columns=["item", "part", "next"])

    return run


def _bits_that_stay(groups: DataFrame, shards: int, items: int) -> int:
    """The most bits of a group's bytes by which all groups up to it fit a cell's share of a shard of what they sum to, or
    0. Only sums by bits reach the driver."""
    sums = {r["bits"]: r["n"] for r in groups.groupBy("bits").agg(F.sum("bytes").alias("n")).collect()}  # 63 rows at most
    stay = lambda bits: sum(n for b, n in sums.items() if b <= bits)
    return max((b for b in sums if (1 << b) * shards * items <= stay(b)), default=0)


def _sums(placed: DataFrame, shards: int) -> list[int]:
    sums = [0] * shards
    for r in placed.groupBy("part").agg(F.sum("bytes").alias("n")).collect():  # a row a shard
        sums[r["part"]] = r["n"]
    return sums


def _levels(groups: DataFrame, shards: int, items: int, cell: int) -> DataFrame:
    """Each cell is differenced alone, then the cells' partial partitions level by level in the same way."""
    groups = cut(groups.groupBy("item").applyInPandas(_groups_of_cell(shards, [], 0), PLACED))
    cells = groups.groupBy("item", "part").agg(F.sum("bytes").alias("bytes")).select(F.col("item").alias("cell"), F.col("part").alias("first"), "item", "part", "bytes")
    while True:
        level = cells.groupBy("item", "part").agg(F.sum("bytes").alias("bytes"))
        placed = level.groupBy(F.floor(F.col("item") / cell)).applyInPandas(_cells_of_cell(shards), "item long, part int, next int")
        cells = cut(cells.join(placed, ["item", "part"]).select("cell", "first", F.floor(F.col("item") / cell).cast("long").alias("item"), F.col("next").alias("part"), "bytes"))
        if items <= cell:
            break
        items = -(-items // cell)
    to = cells.select(F.col("cell").alias("item"), F.col("first").alias("part"), F.col("part").alias("to"))
    return groups.join(to, ["item", "part"]).withColumn("part", F.col("to")).drop("to")


def _rounds(groups: DataFrame, shards: int, items: int, cell: int, sums: list[int]) -> DataFrame:
    """Level the shards, which start from sums. What a round of cells leaves is shared out to the next one, which has
    fewer cells but room for it, down to one cell that sees all that is left."""
    fewer, ends = max(2, cell // (4 * shards)), [items]
    while ends[-1] > 1:
        ends.append(max(1, ends[-1] // fewer))
    left = groups.agg(F.sum("bytes")).first()[0]
    out = None
    for end, start in zip(ends, [*ends[1:], 0], strict=True):
        ahead = [x - min(sums) for x in sums]
        now = groups.filter((F.col("item") >= start) & (F.col("item") < end))
        now = cut(now.groupBy("item").applyInPandas(_groups_of_cell(shards, ahead, left), PLACED))
        more = _sums(now, shards)
        sums, left = [x + y for x, y in zip(sums, more, strict=True)], left - sum(more)
        out = now if out is None else out.unionByName(now)
    return out


def _placed(groups: DataFrame, shards: int, cell: int) -> DataFrame:
    """The groups with part, their shard. Groups that the others could not level within a cell are placed first, in the
    same way, however many they are; the others are then dealt to cells that start from what those leave."""
    n = groups.count()
    items = max(1, -(-n // cell))
    groups = groups.withColumn("item", F.pmod(F.xxhash64("h", "crc"), F.lit(items)))
    if items == 1:
        return groups.groupBy("item").applyInPandas(_groups_of_cell(shards, [], 0), PLACED)
    bits = _bits_that_stay(groups, shards, items)
    if not bits:
        return _placed(groups, shards, 2 * cell)
    large = groups.filter(F.col("bits") > bits)
    if large.isEmpty():
        return _levels(groups, shards, items, cell)
    large = cut(_placed(large, shards, cell))
    return large.unionByName(_rounds(groups.filter(F.col("bits") <= bits), shards, items, cell, _sums(large, shards)))


def slots(df: DataFrame, shard: Column, order: list[Column], rows: int) -> DataFrame:
    """Add slot, counting gapless from 0 within each shard. Rows are numbered in hashed buckets of bounded size,
    and each bucket starts where those before it end, so that no task sees a whole shard."""
    buckets = max(64, rows // 4000)
    df = df.withColumn("_shard", shard).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    starts = df.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(Window.partitionBy("_shard").orderBy("_bucket")) - F.col("_n")).drop("_n")
    df = df.withColumn("_at", F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy(*order)))
    return df.join(starts, ["_shard", "_bucket"]).withColumn("slot", F.col("_start") + F.col("_at") - 1).drop("_shard", "_bucket", "_at", "_start")


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs.

    size is the UTF-8 bytes of the text plus 1. Equal texts form one group, which stays in one shard; a null text
    counts as an empty one and is grouped with it. Groups are dealt by hash to cells of about `cell` groups. Groups
    too large for a cell to balance, given what the other groups sum to, are differenced first, and the cells go on in
    rounds from the difference that is left. Without such groups each cell is differenced alone, then the cells'
    partial partitions are differenced level by level in the same way. A group larger than a shard's share leaves its
    shard that much larger. Null and repeated ids are kept as rows of their own. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"))
    groups = cut(base.groupBy("h", "crc", "size").agg(F.sum("size").alias("bytes")).withColumn("bits", F.length(F.bin("bytes"))))
    rows = groups.agg(F.sum(F.expr("bytes div size"))).first()[0]
    key = ["h", "crc", "size"]
    where = _placed(groups, shards, cell).select(*key, F.col("part").alias("shard"))
    out = base.join(where, key)
    return slots(out, F.col("shard"), [F.col("doc_id"), F.col("crc"), F.col("size")], rows or 0).select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long"))
