"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Each task tokenises its documents, cuts those longer than a sequence, and packs its pieces best-fit (longest
first, each into the fullest bin that takes it). Bins that are nearly full are final. The others go up a tree
as single items: each round gathers the underfull bins of FAN_IN nodes, packs them best-fit again and passes on
what is still underfull, until one node is left.

Which bins go up does not depend on where they lie. Best-fit leaves at most one bin of a block half full or less;
only such a small bin can join another one, and a bin over half full can only take small ones. So all small bins
rise, and of the others as many as small ones are there to fill them, fullest first, counted over the whole table
by fill (LENGTH + 1 numbers). A round moves at most two bins for each block of the table; the surplus stays final.

What moves between tasks is one short row for each such bin, never pieces. A task holds BLOCK items at a time.
Tokenised pieces are written once and only their placement is joined later. The memo of words holds none longer
than MEMORABLE characters, so its entries bound its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Generations, crc32, texts_of, written

LENGTH = 1024
END_ID = 2
#: Free tokens of a bin that count as nearly full.
SLACK = 8
#: Items that a task packs at a time, and nodes that meet in one round.
BLOCK, FAN_IN = 65_536, 8
#: Units longer than this are tokenised each time and not remembered.
MEMORABLE = 64
VOCABULARY = "byte_bpe_50k"

#: White space and words as byte-level BPE pre-tokenises them; a word keeps one leading space.
_UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python calls these white space, Unicode's White_Space property does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class ByteTokenizer:
    """Whole texts to ids as little-endian 32-bit integers, remembering the ids of recent words."""

    def __init__(self, name: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.library.no_padding()
        self.library.no_truncation()
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # The same vocabulary in a library with less overhead a call, for words of Latin letters and signs,
        # where the two agree on what is a letter.
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # A unit that holds a special token's text goes the library's way.
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.memo = Generations(self._unit)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.library.encode(text, add_special_tokens=False).ids)

    def _unit(self, unit: str) -> bytes:
        if max(unit) < "ɐ":
            return self._pack(self.fast.encode_ordinary(unit))
        return self._whole(unit)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text) or (self.special and self.special.search(text)):
            return self._whole(text)
        memo, unit = self.memo, self._unit
        return b"".join([memo[u] if len(u) <= MEMORABLE else unit(u) for u in _UNITS.findall(text)])


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; of several, only the first may be shorter."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin, its offset there, and the bins' fills."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    open_by: list[list[int]] = [[] for _ in range(length + 1)]  # bins by free tokens
    mask = 0  # bit f: some bin has f free tokens
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        rest = mask >> size
        if rest and size:
            free = size + (rest & -rest).bit_length() - 1
            b = open_by[free].pop()
            if not open_by[free]:
                mask ^= 1 << free
        else:
            b, free = len(fills), length
            fills.append(0)
        bin_of[i], offset[i] = b, fills[b]
        fills[b] += size
        left = free - size
        if left:
            open_by[left].append(b)
            mask |= 1 << left
    return bin_of, offset, np.array(fills, np.int64)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, fill long, node int"


def _tokenise_and_pack(length: int, end_id: int, block: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        tokenizer, end = ByteTokenizer(), np.array([end_id], "<u4").tobytes()
        base, held, count = node << 40, [], 0

        def packed() -> pa.RecordBatch:
            nonlocal base
            size = np.array([h[3] for h in held], np.int64)
            at, offset, fills = best_fit(size, length)
            columns = [list(x) for x in zip(*held, strict=True)]
            columns += [at + base, offset, fills[at], np.full(len(held), node)]
            base += len(fills)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer(text) + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, length)):
                    held.append((doc_id, k, start, n, crc32(ids[4 * start : 4 * (start + n)])))
            if len(held) >= block:
                yield packed()
                held = []
        if held:
            yield packed()

    return run


def _merge(length: int, block: int):
    """One round on rows (bin, fill, node) sorted by node: bins as items -> (bin, parent, shift, fill, node)."""
    schema = pa.schema([("bin", pa.int64()), ("parent", pa.int64()), ("shift", pa.int64()), ("fill", pa.int64()), ("node", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[np.ndarray], node: int) -> pa.RecordBatch:
            bins, fill = (np.concatenate([r[i] for r in rows]) for i in range(2))
            at, offset, fills = best_fit(fill, length)
            first = np.zeros(len(fills), np.int64)
            first[at[offset == 0]] = bins[offset == 0]  # a merged bin keeps its first item's name
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (bins, first[at], offset, fills[at])] + [pa.array(np.full(len(bins), node), pa.int32())], schema=schema)

        held, count, last = [], 0, None
        for batch in batches:
            bins, fill, node = (batch.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.nonzero(node[1:] != node[:-1])[0] + 1).tolist(), len(node)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                for lo in range(x, y, block):
                    if held and (node[x] != last or count >= block):
                        yield packed(held, last)
                        held, count = [], 0
                    hi = min(y, lo + block)
                    held.append((bins[lo:hi], fill[lo:hi]))
                    count, last = count + hi - lo, int(node[x])
        if held:
            yield packed(held, last)

    return run


def rising(counts: dict[int, int], length: int = LENGTH) -> dict[int, int]:
    """How many bins of each fill go up, from the number of underfull bins by fill.

    All small ones, and of the others no more than small ones that fit them; none if nothing can merge.
    """
    small = sorted(f for f in counts if 2 * f <= length)
    total = sum(counts[f] for f in small)
    out: dict[int, int] = {}
    used = fits = i = 0
    for f in sorted((f for f in counts if 2 * f > length), reverse=True):
        while i < len(small) and small[i] + f <= length:
            fits += counts[small[i]]
            i += 1
        take = min(counts[f], fits - used)
        if take:
            out[f] = take
            used += take
    return out | {f: counts[f] for f in small} if out or total > 1 else {}


def _risen(items: DataFrame, quota: dict[int, int], counts: dict[int, int]) -> DataFrame:
    """The rows of (bin, fill, node) that go up: all of a fill, or the quota's number, by node and bin."""
    whole = [f for f, n in quota.items() if n == counts[f]]
    partly = {f: n for f, n in quota.items() if n < counts[f]}
    out = items.filter(F.col("fill").isin(whole))
    if not partly:
        return out
    limit = F.create_map(*[F.lit(x).cast("long") for pair in partly.items() for x in pair])
    some = items.filter(F.col("fill").isin(list(partly)))
    # Where each node's bins of a fill begin among all of that fill: a row for each node and fill.
    starts = some.groupBy("fill", "node").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("fill").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("fill", "node", before.alias("start")).filter(F.col("start") < limit[F.col("fill")])
    place = F.col("start") + F.row_number().over(Window.partitionBy("fill", "node").orderBy("bin"))
    return out.unionByName(some.join(starts, ["fill", "node"]).withColumn("place", place).filter(F.col("place") <= limit[F.col("fill")]).select("bin", "fill", "node"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, block: int = BLOCK, fan_in: int = FAN_IN, slack: int = SLACK) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with only the end id. Repeated rows are packed each for itself, null ids
    stay null, and an empty table packs to nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col)
    pieces = written(rows.mapInArrow(_tokenise_and_pack(length, end_id, block), _PIECES))
    items = pieces.filter((F.col("bin_offset") == 0) & (F.col("fill") < length - slack)).select("bin", "fill", "node")
    moved: DataFrame | None = None
    top = pieces.agg(F.max("node")).first()[0] or 0
    while True:
        counts = {r[0]: r[1] for r in items.groupBy("fill").count().collect()}  # at most a row for each fill
        quota = rising(counts, length)
        if not quota:
            break
        items = _risen(items, quota, counts).withColumn("node", (F.col("node") / fan_in).cast("int"))
        parts = max(1, min(top // fan_in + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = items.repartition(parts, "node").sortWithinPartitions("node", "bin")
        merged = written(dealt.mapInArrow(_merge(length, block), "bin long, parent long, shift long, fill long, node int"))
        step = merged.filter("bin <> parent").select("bin", "parent", "shift")
        if moved is None:
            moved = step
        else:
            after = step.select(F.col("bin").alias("parent"), F.col("parent").alias("next"), F.col("shift").alias("more"))
            carried = moved.join(after, "parent", "left").select("bin", F.coalesce("next", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            # A bin that was nobody's part before may move now.
            moved = written(carried.unionByName(step))
        items = merged.filter((F.col("bin") == F.col("parent")) & (F.col("fill") < length - slack)).select("bin", "fill", "node")
        if top == 0:
            break
        top //= fan_in
    if moved is None:
        placed = pieces.select("*", F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    else:
        placed = pieces.join(moved, "bin", "left").select(pieces["*"], F.coalesce("parent", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
