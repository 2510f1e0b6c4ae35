"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at up to RADIUS = 3 differing bits are linked. Two of them are found because the balls around
them meet: every fingerprint emits the variants within half the radius, and equal variants meet in a shuffle.
Half of three is one and a half, so the sides must take one and two bits. Parity settles which: the meeting
points are the variants of *even* parity. A fingerprint of even parity emits its variants at 0 and 2 bits, one
of odd parity those at 1 bit. Any two fingerprints at 1, 2 or 3 bits share such a variant:

* 1 bit: the even one is itself a variant of the other;
* 2 bits, both even: each is a variant of the other; both odd: they share the two points in between;
* 3 bits: one is even and one odd, and they share the three points one bit from the odd one.

Among the members of one variant, those at 0 or 1 bit ("hubs") are within 3 bits of every member, and pairs of
two-bit members that are within 2 bits are each other's variants elsewhere. So linking every member of a
variant to one hub finds the same components as all pairs would, with a number of links that is linear in the
members. Links are still verified by counting the differing bits.

The 1,040 variants of a fingerprint are not shuffled one by one. A variant goes to the bucket of its first
BUCKET_BITS bits, and variants that differ only in later bits share the bucket: one row (bucket, fingerprint)
stands for all of them, and the receiving task expands them. Buckets with very many fingerprints are split by
the bits that follow. Equal fingerprints are reduced to one row before any of this, and components are found
by alternating large-star and small-star rounds over DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, texts_of, written

SHINGLE = 3
SEED = 42
RADIUS = 3
#: First bits of a variant that name its bucket, and the bits after them that split a crowded bucket.
BUCKET_BITS, SPLIT_BITS = 16, 12
#: Rows above which a bucket is split, and rows that a task expands at a time.
CROWDED, AT_ONCE = 4_096, 2_048
#: Fingerprints that more than one row in so many has are hot.
HOT_KEYS = 1_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text; 0 without words."""
    import xxhash

    # bytes.lower() and bytes.split() know ASCII only: A-Z, and the separators 0x20 and 0x09-0x0D.
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return fingerprint_of(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


def fingerprint_of(h: np.ndarray) -> int:
    """The unsigned fingerprint of shingles' hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null and empty texts have 0."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            fps = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "fp": np.array(fps, np.uint64).view(np.int64)}

        return each

    return map_batches(texts_of(docs, id_col, text_col), make, "doc_id long, fp long")


@lru_cache(None)
def _flips(lo: int, hi: int, n: int) -> np.ndarray:
    """Masks of n set bits among bits lo..hi-1."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(lo, hi), n)], np.uint64).reshape(-1)


def _odd(fp: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(fp) & 1).astype(bool)


def _reach(fp: np.ndarray, used: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row and each way to flip some of the bits lo..hi-1 that its parity leaves: row, flipped, bits used.

    ``used`` bits were flipped before; an even fingerprint has two flips in all and an odd one has one.
    """
    rows, masks, total = [], [], []
    left = np.where(_odd(fp), 1, 2) - used
    every = np.arange(len(fp))
    for n in range(3):
        flips = _flips(lo, hi, n)
        can = every[left >= n]
        rows.append(np.repeat(can, len(flips)))
        masks.append(np.tile(flips, len(can)))
        total.append(np.repeat(used[can] + n, len(flips)))
    return np.concatenate(rows), np.concatenate(masks), np.concatenate(total)


def _emit(batch: pa.RecordBatch) -> dict:
    """(fp) -> (bucket, sub 0, fp, used)."""
    fp = batch.column(0).to_numpy().view(np.uint64)
    row, mask, used = _reach(fp, np.zeros(len(fp), np.int64), 64 - BUCKET_BITS, 64)
    bucket = (fp[row] ^ mask) >> np.uint64(64 - BUCKET_BITS)
    return {"bucket": bucket.astype(np.int32), "sub": np.zeros(len(row), np.int32), "fp": fp[row].view(np.int64), "used": used.astype(np.int8)}


def _split(batch: pa.RecordBatch) -> dict:
    """Rows of crowded buckets -> rows by the next bits, sub from 1."""
    fp = batch.column("fp").to_numpy().view(np.uint64)
    used = batch.column("used").to_numpy().astype(np.int64)
    bucket = batch.column("bucket").to_numpy()
    lo = 64 - BUCKET_BITS - SPLIT_BITS
    row, mask, total = _reach(fp, used, lo, 64 - BUCKET_BITS)
    sub = ((fp[row] ^ mask) >> np.uint64(lo)) & np.uint64((1 << SPLIT_BITS) - 1)
    return {"bucket": bucket[row], "sub": sub.astype(np.int32) + 1, "fp": fp[row].view(np.int64), "used": total.astype(np.int8)}


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b: at most as many links as there are fingerprints."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]


def _meet(fp: np.ndarray, used: np.ndarray, bucket: np.ndarray, free_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of whole buckets: expands the variants, sorts them, links each group to a hub."""
    want = np.where(_odd(fp), 1, 2)
    zs, rows, far = [], [], []
    high = bucket << np.uint64(free_bits)
    low = fp & np.uint64((1 << free_bits) - 1)
    base = high | low
    for n in range(3):
        flips = _flips(0, free_bits, n)
        # An odd fingerprint flips exactly one bit, an even one none or two.
        can = np.nonzero((used + n == want) | ((used + n == 0) & (want == 2)))[0]
        zs.append((base[can][:, None] ^ flips[None, :]).reshape(-1))
        rows.append(np.repeat(can, len(flips)))
        far.append(np.repeat(used[can] + n, len(flips)))
    z, row, d = np.concatenate(zs), np.concatenate(rows), np.concatenate(far)
    order = np.lexsort((d, z))
    z, row, d = z[order], row[order], d[order]
    first = np.ones(len(z), bool)
    first[1:] = z[1:] != z[:-1]
    start = np.nonzero(first)[0]
    hub = np.repeat(start, np.diff(np.append(start, len(z))))  # the nearest member comes first
    link = ~first & (d[hub] <= 1)
    a, b = fp[row[hub[link]]], fp[row[link]]
    near = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    pairs = np.unique(np.stack([a[near], b[near]], axis=1), axis=0)
    return _forest(pairs[:, 0], pairs[:, 1])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, sub) -> links. Whole buckets are expanded, some thousand rows at a time."""
    lo = 64 - BUCKET_BITS
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def flush(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fp, used, bucket, sub = (np.concatenate([r[i] for r in rows]) for i in range(4))
        for is_split in (False, True):
            pick = (sub > 0) == is_split
            if not pick.any():
                continue
            free = lo - SPLIT_BITS if is_split else lo
            key = bucket[pick].astype(np.uint64)
            if is_split:
                key = (key << np.uint64(SPLIT_BITS)) | (sub[pick] - 1).astype(np.uint64)
            f, u = fp[pick], used[pick].astype(np.int64)
            edges = _meet_sliced(f, u, key, free)
            if len(edges[0]):
                yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)) for e in edges], schema=schema)

    held: list[np.ndarray] = []
    count, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, sub = batch.column("bucket").to_numpy(), batch.column("sub").to_numpy()
        fp, used = batch.column("fp").to_numpy().view(np.uint64), batch.column("used").to_numpy()
        key = bucket.astype(np.int64) << 32 | sub
        cuts = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if key[x] != last and count >= AT_ONCE:
                yield from flush(held)
                held, count = [], 0
            held.append((fp[x:y], used[x:y], bucket[x:y], sub[x:y]))
            count, last = count + y - x, key[x]
    if held:
        yield from flush(held)


def _meet_sliced(fp: np.ndarray, used: np.ndarray, key: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """As _meet, for any number of rows: if they are many, the variants are taken in slices by their next bits."""
    if len(fp) <= 2 * AT_ONCE or free <= 8:
        return _meet(fp, used, key, free)
    bits = 8
    found = []
    # Which slice a row's variants can fall in is its own bits with at most the remaining flips.
    row, mask, total = _reach(fp, used, free - bits, free)
    piece = ((fp[row] ^ mask) >> np.uint64(free - bits)) & np.uint64((1 << bits) - 1)
    order = np.argsort(piece, kind="stable")
    row, total, piece = row[order], total[order], piece[order]
    edge = np.searchsorted(piece, np.arange((1 << bits) + 1, dtype=np.uint64))
    for p in range(1 << bits):
        x, y = edge[p], edge[p + 1]
        if y - x > 1:
            r = row[x:y]
            found.append(_meet_sliced(fp[r], total[x:y], (key[r] << np.uint64(bits)) | np.uint64(p), free - bits))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints of a distinct (fp) table that connect all within RADIUS bits."""
    shape = "bucket int, sub int, fp long, used byte"
    emitted = map_batches(fps.select("fp"), lambda: _emit, shape)
    # At most 2**BUCKET_BITS rows, whatever the input: safe to broadcast.
    crowded = map_batches(fps.select("fp"), lambda: _emit, shape).groupBy("bucket").count().filter(F.col("count") > CROWDED).select("bucket", F.lit(True).alias("crowded"))
    marked = emitted.join(F.broadcast(crowded), "bucket", "left")
    calm = marked.filter("crowded is null").drop("crowded")
    split = map_batches(marked.filter("crowded").drop("crowded"), lambda: _split, shape)
    parts = max(8, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = calm.unionByName(split).repartition(parts, "bucket", "sub").sortWithinPartitions("bucket", "sub")
    return dealt.mapInArrow(_links, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node of its component.

    Alternates large-star and small-star: each round is two aggregations and joins on keys, and is written
    out, so lineage stays short. The driver sees only a count and a sum for each round.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        # Large star: every larger neighbour is tied to the node's smallest neighbour.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour and the node itself are tied to the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)


def _spread_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key and in ``n`` how many rows have it.

    Keys of more than one row in HOT_KEYS are fewer than HOT_KEYS: they are broadcast, so their rows stay where they
    are. The others are joined by a shuffle in which no key is large.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_KEYS > total
    hot, cold = F.broadcast(table.filter(is_hot).drop("n")), table.filter(~is_hot).drop("n")
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(table.filter(is_hot).select(key)), key, "left_anti").join(cold, key))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """One row for each document: doc_id, fp (long), fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most RADIUS differing bits. Null and empty
    texts have fingerprint zero and are linked like any other; rows without a doc_id take part, but give no
    component its name unless it has no other (then it is null); repeated rows stay repeated; an empty table
    gives an empty result. Columns other than the two named are ignored.
    """
    marked = written(fingerprints(docs, id_col, text_col, width))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    comp = components(near_links(distinct.select("fp")))
    # Only linked fingerprints have a row in comp.
    linked = distinct.join(comp, distinct["fp"] == comp["node"]).select("root", "node", "first_id")
    roots = distinct.join(comp.select(F.col("root").alias("fp")).distinct(), "fp", "left_semi").select(F.col("fp").alias("root"), F.col("fp").alias("node"), "first_id")
    members = written(linked.unionByName(roots))
    named = members.groupBy("root").agg(F.min("first_id").alias("named"))
    named = members.join(named, "root").select(F.col("node").alias("fp"), "named")
    by_fp = written(distinct.join(named, "fp", "left").select("fp", F.coalesce("named", "first_id").alias("component_id"), "n"))
    return _spread_join(marked, by_fp, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_sha(text_col: str) -> Column:
    """SHA-256 of a text; null texts have that of the empty one."""
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)


def kept_rows(docs: DataFrame, keep: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and text hash are in ``keep`` (__id, __sha): __row, a structure of all their columns,
    and the columns of ``keep``. Of equal rows one."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    own = docs.select(row, F.col(id_col).cast("long").alias("__own_id"), text_sha(text_col).alias("__own"))
    kept = own.join(keep, own["__own_id"].eqNullSafe(keep["__id"]) & (own["__own"] == keep["__sha"]), "inner")
    w = Window.partitionBy("__id", "__sha").orderBy(F.lit(1))
    return kept.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__own", "__own_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id (rows without one come last).

    All columns stay. Of rows that repeat both doc_id and text one stays. Texts are shuffled once, by their row's
    own key, so a large group of copies is spread out.
    """

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            fps = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "sha": batch.column(2), "fp": np.array(fps, np.uint64).view(np.int64)}

        return each

    rows = texts_of(docs, id_col, text_col).withColumn("sha", text_sha("text"))
    marked = written(map_batches(rows, make, "doc_id long, sha string, fp long"))
    # The smallest (doc_id, sha) of each fingerprint, then of each component.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("sha").alias("sha")))
    distinct = written(marked.groupBy("fp").agg(first.alias("first")))
    comp = components(near_links(distinct.select("fp")))
    rooted = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    keep = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("__id"), F.col("first.sha").alias("__sha"))
    return kept_rows(docs, keep, id_col, text_col).select("__row.*")
