"""Approximate nearest neighbours by collision-counting hashing.

Largest inner product is turned into smallest distance by one more coordinate: every vector is scaled by the
largest norm and lifted to the unit sphere (queries get 0 there), so order by inner product and order by
distance agree.

Each of PROJECTIONS hash functions is one projection on a random direction; directions come in whole random
rotations, which tell near from far with fewer of them than independent ones. A block of vectors keeps every
projection as a sorted array, cut into CELLS cells. A query looks at a window of each array centred on its own
projection; a vector collides once for each window it falls into. The windows widen by virtual rehashing - the same
sorted arrays, radius times RATIO - until enough vectors have collided in at least the threshold's share of the
projections. Those are verified: their exact inner products, in double precision on the original vectors, decide.

Collisions are counted for 64 vectors in one machine word. For every cell's edge of a sorted array a block keeps the
set of vectors before it, one bit each; a window is the difference of two such sets, and counters in binary, a word
for each digit, add the windows up. So a query costs PROJECTIONS words for each 64 vectors and widening, and the
verification of SHARE of the block.

What this does not give is work that is sublinear in the table: queries are a share of the rows and each is counted
against every block, so work grows with rows times queries (in blocks, which any number of tasks can share). On
vectors without structure, as in the tables here, no hashing avoids that at a recall of 0.9. Inner products exist
between vectors of one dimension only; each dimension is searched on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PROJECTIONS = 128
#: Share of the projections in which a vector must collide to be verified.
THRESHOLD = 0.8
#: The first half-width of a window in standard deviations of the projections, and the widening factor.
WIDTH, RATIO = 1.4, 1.04
#: Vectors to verify for each query before it stops widening: this share of its block, and so many times k.
SHARE, TIMES = 0.02, 5
CELLS = 128
VECTORS, QUERIES = 16_384, 4_096
#: Queries that are counted together.
TOGETHER = 32
SEED = 20_24


def clean(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, row) of the rows that take part; row numbers them, once the table is written.

    Null ids, null, empty or zero vectors and those with null or non-finite components take no part. Rows that
    repeat an id are rows of their own.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(finite).withColumn("row", F.monotonically_increasing_id())


def directions(dim: int, count: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """(dim, count): columns of random rotations."""
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(turns, axis=1)[:, :count]


class Counter:
    """Binary counters for many sets of bits: plane i holds digit i of every count."""

    def __init__(self):
        self.planes: list[np.ndarray] = []
        #: At each digit the sets that wait for two others of the same weight.
        self.waiting: list[list[np.ndarray]] = []

    def add(self, bits: np.ndarray, digit: int = 0) -> None:
        while len(self.waiting) <= digit:
            self.waiting.append([])
        held = self.waiting[digit]
        held.append(bits)
        if len(held) == 3:  # three of one weight are one of that weight and one of the next
            a, b, c = held
            half = a ^ b
            self.waiting[digit] = [half ^ c]
            self.add((a & b) | (half & c), digit + 1)

    def at_least(self, least: int) -> np.ndarray:
        """The set of those counted ``least`` times or more."""
        digit = 0
        while digit < len(self.waiting):
            held = self.waiting[digit]
            if len(held) == 2:
                carry = held[0] & held[1]
                self.waiting[digit] = [held[0] ^ held[1]]
                self.add(carry, digit + 1)
            digit += 1
        planes = [h[0] if h else None for h in self.waiting]
        some = next(p for p in planes if p is not None)
        if least >= 1 << len(planes):
            return np.zeros_like(some)
        more, equal = np.zeros_like(some), np.full_like(some, ~np.zeros((), some.dtype))
        for i in range(len(planes) - 1, -1, -1):
            plane = planes[i] if planes[i] is not None else np.zeros_like(some)
            if least >> i & 1:
                equal &= plane
            else:
                more |= equal & plane
                equal &= ~plane
        return more | equal


class BlockIndex:
    """The sorted projections of a block of vectors, and the sets of vectors before each cell's edge."""

    def __init__(self, x: np.ndarray, top: float, projections: int = PROJECTIONS, cells: int = CELLS, seed: int = SEED):
        n, dim = x.shape
        self.x, self.n, self.cells = x, n, min(cells, n)
        self.a = directions(dim + 1, projections, seed)
        lift = np.sqrt(np.maximum(0.0, 1 - (x**2).sum(axis=1) / top**2))
        px = (x / top) @ self.a[:dim] + lift[:, None] * self.a[dim]
        self.unit = WIDTH * float(px.std()) or 1.0
        order = np.argsort(px, axis=0, kind="stable").T
        self.keys = np.take_along_axis(px.T, order, axis=1)
        #: Places of the edges in a sorted array; the first is 0 and the last n.
        self.edges = np.arange(self.cells + 1) * n // self.cells
        words = -(-n // 64)
        self.before = np.zeros((projections, self.cells + 1, words), np.uint64)
        cell = np.empty(n, np.int32)
        numbers = np.arange(self.cells + 1, dtype=np.int32)[:, None]
        of_place = np.searchsorted(self.edges, np.arange(n), side="right") - 1
        for j in range(projections):
            cell[order[j]] = of_place
            bits = np.packbits(cell[None, :] < numbers, axis=1, bitorder="little")
            self.before[j].view(np.uint8)[:, : bits.shape[1]] = bits

    def window(self, j: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.before[j, hi] ^ self.before[j, lo]

    def candidates(self, q: np.ndarray, need: int, threshold: float = THRESHOLD) -> np.ndarray:
        """(queries, words): for each query the set of vectors to verify."""
        projections = len(self.keys)
        least = max(1, int(np.ceil(threshold * projections)))
        dim = q.shape[1]
        pq = (q / np.maximum(np.sqrt((q**2).sum(axis=1, keepdims=True)), 1e-300)) @ self.a[:dim]
        out = np.zeros((len(q), self.before.shape[2]), np.uint64)
        active, radius = np.arange(len(q)), self.unit
        while len(active):
            counter, all_in = Counter(), np.ones(len(active), bool)
            for j in range(projections):
                centre = pq[active, j]
                # The nearest cells' edges to the window's ends.
                lo = (np.searchsorted(self.keys[j], centre - radius) * self.cells + self.n // 2) // self.n
                hi = (np.searchsorted(self.keys[j], centre + radius, side="right") * self.cells + self.n // 2) // self.n
                all_in &= (lo == 0) & (hi == self.cells)
                counter.add(self.window(j, lo, hi))
            found = counter.at_least(least)
            done = (np.bitwise_count(found).sum(axis=1) >= need) | all_in
            out[active[done]] = found[done]
            active, radius = active[~done], radius * RATIO
        return out


def search_block(x: np.ndarray, q: np.ndarray, skip: np.ndarray, k: int, top: float, verified: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, inner product) of each query's k best found in a block.

    skip: for each query, the row in x that is the query itself, or -1. top: the largest norm of all. ``verified``
    gets the number of verified vectors of each query.
    """
    index = BlockIndex(x, top)
    need = min(len(x), max(TIMES * k, int(SHARE * len(x))) + 1)
    rows, found, scores = [], [], []
    for first in range(0, len(q), TOGETHER):
        some = q[first : first + TOGETHER]
        sets = index.candidates(some, need)
        bits = np.unpackbits(sets.view(np.uint8), axis=1, bitorder="little", count=len(x))
        for i, own in enumerate(bits, first):
            cand = np.nonzero(own)[0]
            cand = cand[cand != skip[i]]
            if verified is not None:
                verified.append(len(cand))
            exact = x[cand] @ q[i]
            if len(cand) > k:
                edge = np.partition(exact, len(cand) - k)[len(cand) - k]
                # Ties at the edge stay, for the final order to settle by id; the block's rows are sorted by id.
                pick = np.nonzero(exact >= edge)[0]
                pick = pick[np.lexsort((cand[pick], -exact[pick]))[:k]]
            else:
                pick = np.arange(len(cand))
            rows.append(np.full(len(pick), i))
            found.append(cand[pick])
            scores.append(exact[pick])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", vectors: int = VECTORS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for every row whose id ``every`` divides.

    Candidates are all rows of the query's dimension but the query's own; fewer than k are all returned; ties go to
    the smaller vec_id. Rows that repeat an id are candidates, and queries, each for itself.
    """
    spark = df.sparkSession
    rows = written(clean(df, id_col, vector_col))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # A row for each dimension that occurs.
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(norm).alias("top")).orderBy("dim").collect()
    plan, first = [], 0
    for r in dims:
        nb, qb = max(1, -(-r["n"] // vectors)), max(1, -(-r["q"] // queries))
        plan.append((r["dim"], nb, qb, first, r["top"]))
        first += nb * qb
    table = spark.createDataFrame(plan, "dim int, nb int, qb int, first long, top double")
    placed = rows.join(F.broadcast(table), F.size("v") == F.col("dim"))
    spread = lambda m, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(m))
    copies = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    columns = ("vec_id", "row", "v", "top", "unit", "is_q")
    # A unit of work is one block of vectors and one block of queries.
    data = placed.withColumn("b", spread("nb", 1)).withColumn("c", copies("qb")).withColumn("is_q", F.lit(False))
    asked = placed.filter(F.col("vec_id") % every == 0).withColumn("c", spread("qb", 2)).withColumn("b", copies("nb")).withColumn("is_q", F.lit(True))
    with_unit = lambda d: d.withColumn("unit", F.col("first") + F.col("b") * F.col("qb") + F.col("c")).select(*columns)
    # Three tasks for each unit, so that units rarely meet in one.
    both = with_unit(data).unionByName(with_unit(asked)).repartition(max(1, 3 * first), "unit").sortWithinPartitions("unit", "is_q", "vec_id", "row")
    schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            is_q, ids, own = t["is_q"].to_numpy(), t["vec_id"].to_numpy(), t["row"].to_numpy()
            flat = t["v"].chunk(0)
            v = flat.values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py() : flat.offsets[-1].as_py()].reshape(len(ids), -1)
            if is_q.all() or not is_q.any():
                return
            xr, qr = own[~is_q], own[is_q]
            order = np.argsort(xr)
            at = order[np.minimum(np.searchsorted(xr, qr, sorter=order), len(xr) - 1)]
            r, c, s = search_block(v[~is_q], v[is_q], np.where(xr[at] == qr, at, -1), k, t["top"][0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[is_q][r], qr[r], ids[~is_q][c], xr[c], s)], schema=schema)

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = batch.column("unit").to_numpy()
            cuts = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if held and key[x] != last:
                    yield from block(held)
                    held = []
                held.append(batch.slice(x, y - x))
                last = key[x]
        if held:
            yield from block(held)

    found = both.mapInArrow(run, "query_id long, query_row long, vec_id long, row long, score double")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
