"""Near-duplicate documents by SetSketch registers: banded, compared by likelihood, verified on whole sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import components, cut, release

#: SetSketch parameters: base, rate and limit of the registers, which are 16 bits wide.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
REGISTERS, BAND = 192, 6
#: Registers are estimates: a pair is dropped before verification if its estimate is this far below the threshold,
#: nearly five standard deviations.
MARGIN = 0.14
#: Rounds of links with hubs, and members of a tile at most on average.
HUB_ROUNDS, TILE = 2, 2048
#: Bytes of a text that are hashed at once, and shingles of a tile at most on average.
PIECE, TILE_SHINGLES = 1 << 16, 4_000_000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_VALUES[65:91] = _VALUES[97:123]  # A-Z as a-z
_LETTER = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0xD6E8FEB86659FD93
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text: A-Z count as a-z, words end at ASCII white space. A word's hash is the sum
    of its bytes' values times powers of a base, so the prefix sums of a piece give all its words, and a word
    that goes on in the next piece is the sum of its parts."""
    every = np.frombuffer(data, dtype=np.uint8)
    found: list[np.ndarray] = []
    begun, length = 0, 0  # a word that the piece before did not end
    for at in range(0, len(every), PIECE):
        piece = every[at : at + PIECE]
        word = _LETTER.take(piece)
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        edges = np.concatenate(([0] if word[0] else [], edges, [len(piece)] if word[-1] else [])).astype(np.int64)
        start, end = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES.take(piece) * _UP[: len(piece)])))
        h = (sums[end] - sums[start]) * _DOWN[start]
        if length and word[0]:
            h[0] = np.uint64((begun + int(h[0]) * pow(_BASE, length, 1 << 64)) % (1 << 64))
            length += int(end[0])
        elif length:
            found.append(np.array([begun], dtype=np.uint64))
        if word[-1]:
            begun, length, h = int(h[-1]), length if length and len(h) == 1 and word[0] else int(end[-1] - start[-1]), h[:-1]
        else:
            length = 0
        found.append(h)
    if length:
        found.append(np.array([begun], dtype=np.uint64))
    return _mix(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def shingle_set(data: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word sequences of the given size in a UTF-8 text. A text with fewer words is
    one sequence; without words the set is empty."""
    h = word_hashes(data or b"")
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = _mix(out * np.uint64(_STEP) + h[i : len(h) - n + 1 + i])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _coefficients(registers: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * registers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:registers] | np.uint64(1), seeds[registers:]


def registers_of(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SetSketch registers: floor(1 - log_BASE of the least of the elements' exponentials), truncated to 0..LIMIT.

    An element's exponential of rate RATE is -ln(1 - u) / RATE for its uniform hash u, which grows with u, so the
    least hash gives it. The registers of a union are the maxima of the parts' registers.
    """
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(low, (shingles[at : at + 512, None] * a + b).min(axis=0), out=low)
    u = (low.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def joint_estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Jaccard similarities of pairs of sketches (rows of x and y) of sets of known sizes, by maximum likelihood of
    the numbers of registers above, below and equal, by golden-section search."""
    above, below = (x > y).sum(axis=1), (x < y).sum(axis=1)
    equal = x.shape[1] - above - below
    u, v = nx / (nx + ny), ny / (nx + ny)
    scale = (BASE - 1) / BASE

    def p(z: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(z, 0, 1) * scale) / np.log(BASE)

    def loss(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        return -(above * np.log(more + 1e-12) + below * np.log(less + 1e-12) + equal * np.log(np.maximum(1 - more - less, 1e-12)))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (5**0.5 - 1) / 2
    for _ in range(24):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = loss(c) < loss(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def sketches(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", registers: int = REGISTERS) -> DataFrame:
    """id, n (set size), k1, k2 (128-bit hash of the set), regs and text (UTF-8 bytes) for every row."""

    def run(batches):
        a, b = _coefficients(registers)
        for batch in batches:
            sizes, keys, regs = [], [], []
            for data in batch.column(1).to_pylist():
                s = shingle_set(data, size)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                regs.append(registers_of(s, a, b).tobytes() if len(s) else None)
            key = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(regs, pa.binary()), batch.column(1)], ["id", "n", "k1", "k2", "regs", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n long, k1 long, k2 long, regs binary, text binary")


class _Tile:
    """Members of one group: the links between its two sides, or among all members if there is but one side.

    Pairs of one component are passed over, also of one that a link just found has joined. Others must be of the group's
    band and share no band before it, where another group has them; then their sizes, their equal registers and
    their likelihood must allow the threshold, and their whole sets are compared.
    """

    def __init__(self, rows: pa.Table, size: int, num: int, den: int) -> None:
        self.size, self.num, self.den = size, num, den
        self.rep, self.n, self.side, self.band = (rows.column(c).to_numpy() for c in ("rep", "n", "side", "band"))
        self.root = rows.column("c").to_numpy().copy()
        self.regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), dtype=np.uint16).reshape(len(self.rep), -1)
        self.texts, self.sets = rows.column("text"), {}

    def set_of(self, i: int) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = shingle_set(self.texts[i].as_py(), self.size)
        return self.sets[i]

    def likely(self, i: int, j: np.ndarray) -> np.ndarray:
        threshold, n = self.num / self.den, self.n
        j = j[self.root[j] != self.root[i]]
        j = j[self.den * np.minimum(n[j], n[i]) >= self.num * np.maximum(n[j], n[i])]
        if len(j):
            equal = self.regs[j] == self.regs[i]
            keep = equal.mean(axis=1) >= threshold - MARGIN - 0.1  # a cheap bound; the rest by likelihood
            if self.band[i] >= 0:
                shared = equal.reshape(len(j), -1, BAND).all(axis=2)
                keep &= (self.band[j] == self.band[i]) & (shared.argmax(axis=1) == self.band[i])
            j = j[keep]
        if len(j):
            j = j[joint_estimate(np.broadcast_to(self.regs[i], (len(j), self.regs.shape[1])), self.regs[j], np.full(len(j), n[i], float), n[j].astype(float)) >= threshold - MARGIN]
        return j

    def links(self) -> list[tuple[int, int]]:
        low = np.flatnonzero(self.side == 0)
        high = np.flatnonzero(self.side == 1)
        found = []
        for i in low.tolist():
            todo = self.likely(i, high if len(high) else low[low > i])
            while len(todo):
                now, todo = todo[:64], todo[64:]
                own, others = self.set_of(i), [self.set_of(j) for j in now.tolist()]
                every = np.concatenate(others)
                at = np.minimum(np.searchsorted(own, every), len(own) - 1)
                both = np.add.reduceat(own[at] == every, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)
                for j in now[self.den * both >= self.num * (len(own) + self.n[now] - both)].tolist():
                    if self.root[j] != self.root[i]:
                        found.append((int(self.rep[i]), int(self.rep[j])))
                        self.root[self.root == self.root[j]] = self.root[i]
                todo = todo[self.root[todo] != self.root[i]]
        return found


def _compared(size: int, num: int, den: int):
    """Links of groups (the first two columns) whose rows follow each other."""
    def run(batches):
        held: list[pa.RecordBatch] = []

        def out():
            links = _Tile(pa.Table.from_batches(held).combine_chunks(), size, num, den).links()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), keys.shape[1]]
            for start, end in zip(edges, edges[1:], strict=False):
                if end > start:
                    if held and any(held[-1].column(i)[0].as_py() != keys[i, start] for i in (0, 1)):
                        yield out()
                    held.append(batch.slice(start, end - start))
        if held:
            yield out()

    return run


def near_duplicates(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Rows with equal sets become one representative. Representatives that share a band of registers are candidates;
    a candidate pair is linked if the whole sets pass den * intersection >= num * union. A bucket's members are
    first compared with one hub, so that a group of copies costs a few pairs for each member; this is done
    HUB_ROUNDS times, the hub drawn anew, for the buckets whose members are not yet in one component. Then each
    pair of a bucket that is still in different components is compared, in tiles of bounded size: the members
    of the bucket's largest component meet only the others, never each other. None is lost.

    component_id is the smallest id that links reach, itself included; kept tells that it is the row's own. A null
    or empty text, or one without words, has n_shingles 0 and its own id as component. Rows with a null id are linked
    with nothing: component_id is null, kept true. Rows that repeat an id are one node of the graph: the sets
    of all of them stand for the id. Extra columns are ignored. An empty table gives no rows.
    """
    num, den = similarity
    spark = docs.sparkSession
    known = cut(sketches(docs, size, id_col, text_col))
    usable = known.filter("id is not null and n > 0").select("id", "n", "k1", "k2", "regs")
    reps = cut(usable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    width = 2 * BAND
    keys: list[Column] = [F.xxhash64(F.lit(i), F.substring("regs", 1 + i * width, width)) for i in range(REGISTERS // BAND)]
    bands = reps.select("k1", "k2", "rep", "n", F.posexplode(F.array(*keys)).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("key")
    buckets = cut(bands.join(shared, "key"))
    # the whole texts of the members, once for each set
    members = buckets.groupBy("k1", "k2").agg(F.first("rep").alias("rep"))
    own = known.filter("n > 0").withColumnRenamed("id", "rep").join(members, ["k1", "k2", "rep"], "left_semi")
    units = cut(own.groupBy("k1", "k2").agg(F.first("regs").alias("regs"), F.first("text").alias("text")))

    def compare(dealt: DataFrame) -> DataFrame:
        """Links of dealt (grp, sub, side, k1, k2, rep, n, c, band)."""
        dealt = cut(dealt)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(50_000, dealt.count() // 2_000))
        rows = dealt.join(units, ["k1", "k2"]).select("grp", "sub", "side", "rep", "n", "c", F.col("band").cast("long").alias("band"), "regs", "text")
        found = cut(rows.repartition(parts, "grp", "sub").sortWithinPartitions("grp", "sub", "side", "rep").mapInArrow(_compared(size, num, den), "a long, b long"))
        release(dealt)
        return found

    def tiles(count: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(count / TILE, shingles / TILE_SHINGLES))

    node = ["k1", "k2", "rep", "n", "c"]

    def with_hubs(members: DataFrame, salt: int) -> DataFrame:
        """Links of members with the hub of their bucket; those of the hub's component need none."""
        drawn = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("k1", F.lit(salt)).alias("h"), *[F.col(x).alias(f"h_{x}") for x in node])).alias("m")).select("key", "m.*")
        pairs = members.join(drawn, "key").filter("c <> h_c").select(*node, *[f"h_{x}" for x in node]).distinct()
        kept = pairs = cut(pairs)
        of_hub = pairs.groupBy("h_k1", "h_k2").agg(tiles(F.count("*"), F.sum("n")).alias("tiles"))
        pairs = pairs.join(of_hub, ["h_k1", "h_k2"]).select("*", F.col("h_k1").alias("grp"), F.pmod(F.xxhash64("k1", F.lit(5)), F.col("tiles")).alias("sub"))
        hubs = pairs.select("grp", "sub", F.lit(0).alias("side"), *[F.col(f"h_{x}").alias(x) for x in node], F.lit(-1).alias("band")).distinct()
        links = compare(hubs.unionByName(pairs.select("grp", "sub", F.lit(1).alias("side"), *node, F.lit(-1).alias("band"))))
        release(kept)
        return links

    def unsettled(found: DataFrame) -> DataFrame:
        """Members, with component c, of the buckets that hold more than one component."""
        members = buckets.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("key", "band", "k1", "k2", "rep", "n", F.coalesce("component", "rep").alias("c"))
        spread = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
        return cut(members.join(spread, "key"))

    def in_tiles(members: DataFrame) -> DataFrame:
        """Links of all pairs of a bucket but those within its largest component, which is dealt to tiles of its own."""
        parts = members.groupBy("key", "c").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
        most = F.max(F.struct("count", "n", "c")).alias("m")
        sizes = parts.groupBy("key").agg(most, F.sum("count").alias("count"), F.sum("n").alias("n"))
        others, rest = F.col("count") - F.col("m.count"), F.col("n") - F.col("m.n")
        sizes = sizes.select("key", F.col("m.c").alias("main"), tiles(F.col("m.count"), F.col("m.n")).alias("mains"), tiles(others, rest).alias("tiles"))
        dealt = members.join(sizes, "key").withColumn("is_main", F.col("c") == F.col("main"))
        dealt = dealt.withColumn("t", F.pmod(F.xxhash64("k1", F.lit(3)), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("tiles"))))
        dealt = dealt.withColumn("o", F.explode(F.when(F.col("is_main"), F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).otherwise(F.sequence(-F.col("mains"), F.col("tiles") - 1))))
        # tiles of the main component are numbered below 0
        t = F.when(F.col("is_main"), -1 - F.col("t")).otherwise(F.col("t"))
        low, high = F.least(t, "o"), F.greatest(t, "o")
        return compare(dealt.select(F.col("key").alias("grp"), (low * (1 << 32) + high).alias("sub"), (t > F.col("o")).cast("int").alias("side"), *node, "band"))

    # an id that has several sets is linked with the representatives of them all
    several = usable.groupBy("id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low <> high").select("id")
    links = cut(usable.join(several, "id").select("id", "k1", "k2").distinct().join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")))
    found = components(links)
    for salt in range(HUB_ROUNDS):
        open_ = unsettled(found)
        links = links.unionByName(with_hubs(open_, salt))
        found = components(links)
        release(open_)
    open_ = unsettled(found)
    last = in_tiles(open_)
    release(open_, units, buckets)
    if not last.isEmpty():
        found = components(links.unionByName(last))
    of_rep = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("c"))
    out = known.select("id", "n", "k1", "k2").join(of_rep, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce(F.when(F.col("n") > 0, F.col("c")), F.col("id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
