"""SimHash near-duplicates through a hierarchical index in Gray order.

Equal fingerprints are one from the start.  The distinct ones are sorted by
Gray rank, in which neighbours share many bits, and cut into blocks by one
range shuffle.  Over every block stands a tree: a node keeps the bits that all
fingerprints below it share and its parent does not already hold.  Two trees
are walked together; the differences between the bits two nodes share add up on
the way down, and whole groups are left as soon as they exceed the radius.

Linked fingerprints are joined inside a task at once, and only one edge per
joined part leaves it: components stay exact and no group is written as pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import boxed, connected_components, ship, written

SEED = 42
FAN = 4
#: Pairs of nodes opened at once.
STEP = 1 << 15
#: Fingerprints per block grow with the root of their number, so that the
#: blocks two of which meet in a task stay few; there are never more than these.
BLOCK_ROOT, MOST_BLOCKS = 64, 4096
#: Rows of the broadcast table that marks fingerprints of larger components; a shared slot only costs a shuffle of its rows.
SLOTS = 1 << 20


# -- fingerprints -------------------------------------------------------------------


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash of the word shingles of a whole text, A-Z in lower case, repeats counted."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())], dtype="<u8"
    )
    return int(_majority(hashes))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[low : low + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, words: int, text: str = "text") -> DataFrame:
    """The columns of ``rows`` but its text, and ``fp`` (the 64 bits as a long)."""
    others = [c for c in rows.columns if c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(text)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(found.view(np.int64))], names=[*others, "fp"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text]
    return ship(rows).mapInArrow(run, ", ".join([*schema, "fp long"]))


def gray_rank(fp: Column) -> Column:
    """Place of the fingerprint in the Gray sequence; neighbours there differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


# -- the index ----------------------------------------------------------------------


class Tree:
    """Nodes over fingerprints in Gray order, ``FAN`` children each; level 0 are the fingerprints."""

    def __init__(self, fps: np.ndarray) -> None:
        self.n = len(fps)
        size = FAN
        while size < self.n:
            size *= FAN
        row = np.concatenate([fps, np.repeat(fps[-1:], size - self.n)])
        ones, any_ = row, row
        self.pattern, self.mask = [row], [np.full(size, ~np.uint64(0))]
        while len(ones) > 1:
            ones = np.bitwise_and.reduce(ones.reshape(-1, FAN), axis=1)
            any_ = np.bitwise_or.reduce(any_.reshape(-1, FAN), axis=1)
            self.pattern.append(ones)
            self.mask.append(ones | ~any_)  # bits that all below share
        self.top = len(self.pattern) - 1

    def spans(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and largest label below every node."""
        low = np.concatenate([labels, np.repeat(labels[-1:], len(self.pattern[0]) - self.n)])
        high, out = low, [(low, low)]
        for _ in range(self.top):
            low, high = low.reshape(-1, FAN).min(axis=1), high.reshape(-1, FAN).max(axis=1)
            out.append((low, high))
        return out


def _joined(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> bool:
    """Gives linked items one label, the least; True if any changed."""
    changed = False
    while True:
        lu, lv = labels[u], labels[v]
        apart = lu != lv
        if not apart.any():
            return changed
        changed = True
        u, v, lu, lv = u[apart], v[apart], lu[apart], lv[apart]
        np.minimum.at(labels, np.maximum(lu, lv), np.minimum(lu, lv))
        while True:
            deeper = labels[labels]
            if (deeper == labels).all():
                break
            labels[:] = deeper


def link(a: Tree, b: Tree, labels: np.ndarray, radius: int, same: bool) -> None:
    """Joins the labels of all fingerprints of ``a`` and ``b`` within ``radius`` bits; ``b``'s follow ``a``'s.

    A label is an item's number, and an item with its own number as label is a root.
    Pairs of nodes below which all have one label already are not opened.
    """
    shift = 0 if same else a.n
    children = np.arange(FAN)
    left, right = (a, b) if a.top >= b.top else (b, a)
    at = (lambda t: 0) if same else (lambda t: 0 if t is a else shift)
    fresh, spans = True, None
    zero = np.zeros(1, dtype=np.int64)
    # Entries: level in each tree, nodes, differences so far, bits both nodes' parents share.
    stack = [(left.top, right.top, zero, zero, zero.astype(np.uint8), np.zeros(1, dtype=np.uint64))]
    while stack:
        p, q, x, y, apart, held = stack.pop()
        if len(x) > STEP:
            cut = len(x) - STEP
            stack.append((p, q, x[:cut], y[:cut], apart[:cut], held[:cut]))
            x, y, apart, held = x[cut:], y[cut:], apart[cut:], held[cut:]
        shared = left.mask[p][x] & right.mask[q][y]
        apart = apart + np.bitwise_count((left.pattern[p][x] ^ right.pattern[q][y]) & shared & ~held)
        keep = apart <= radius
        if same:
            keep &= x <= y if p else x < y
        if p == 0 and q == 0:
            keep &= (x < left.n) & (y < right.n)
            if keep.any():
                fresh |= _joined(labels, x[keep] + at(left), y[keep] + at(right))
            continue
        if fresh:
            own = lambda t: labels[at(t) : at(t) + t.n]
            spans = left.spans(own(left)), right.spans(own(right))
            fresh = False
        (low_x, high_x), (low_y, high_y) = spans[0][p], spans[1][q]
        keep &= ~((low_x[x] == high_x[x]) & (low_y[y] == high_y[y]) & (low_x[x] == low_y[y]))
        x, y, apart, shared = x[keep], y[keep], apart[keep], shared[keep]
        if not len(x):
            continue
        if p > q:  # the deeper tree comes down to the other's level first
            x, y = (x[:, None] * FAN + children).reshape(-1), np.repeat(y, FAN)
            stack.append((p - 1, q, x, y, np.repeat(apart, FAN), np.repeat(shared, FAN)))
        else:
            x, y = np.repeat(x[:, None] * FAN + children, FAN, axis=1).reshape(-1), np.tile(
                y[:, None] * FAN + children, (1, FAN)
            ).reshape(-1)
            stack.append((p - 1, q - 1, x, y, np.repeat(apart, FAN * FAN), np.repeat(shared, FAN * FAN)))


_BLOCK = "block long, n long, mask long, pattern long, fps binary, roots binary"


def _block_rows(radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        fps = np.concatenate(parts).view(np.uint64) if parts else np.zeros(0, dtype=np.uint64)
        if not len(fps):
            return
        tree, labels = Tree(fps), np.arange(len(fps))
        link(tree, tree, labels, radius, same=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([len(fps)], pa.int64()),
             pa.array(tree.mask[-1].view(np.int64)), pa.array(tree.pattern[-1].view(np.int64)),
             pa.array([fps.astype("<u8").tobytes()], pa.binary()), pa.array([labels.astype("<i8").tobytes()], pa.binary())],
            names=["block", "n", "mask", "pattern", "fps", "roots"],
        )

    return run


def _partners(radius: int, masks: np.ndarray, patterns: np.ndarray, numbers: np.ndarray):
    """Every block with every other whose shared bits do not already differ too much, under the pair's name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                me = row.column("block")[0].as_py()
                here = int(np.searchsorted(numbers, me))
                near = np.bitwise_count((patterns ^ patterns[here]) & masks & masks[here]) <= radius
                others = numbers[near & (numbers != me)]
                for low in range(0, len(others), 64):
                    some = others[low : low + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(some, me)), pa.array(np.maximum(some, me)),
                         pa.array(np.full(len(some), me)), *[pa.array(row.column(c).to_pylist() * len(some), row.column(c).type) for c in ("fps", "roots")]],
                        names=["first", "second", "block", "fps", "roots"],
                    )

    return run


def _cross(radius: int):
    def run(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("block")
        fps = [np.frombuffer(b, dtype="<u8") for b in pair["fps"]]
        roots = [np.frombuffer(b, dtype="<i8") for b in pair["roots"]]
        a, b = Tree(fps[0]), Tree(fps[1])
        start = np.concatenate([roots[0], roots[1] + a.n])
        labels = start.copy()
        link(a, b, labels, radius, same=False)
        every = np.concatenate(fps).view(np.int64)
        moved = np.flatnonzero((start == np.arange(len(start))) & (labels != start))
        return pd.DataFrame({"u": every[moved], "v": every[labels[moved]]})

    return run


def _inner_edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for fps, roots in zip(batch.column("fps"), batch.column("roots"), strict=True):
            every, root = np.frombuffer(fps.as_py(), dtype="<i8"), np.frombuffer(roots.as_py(), dtype="<i8")
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(every[moved]), pa.array(every[root[moved]])], names=["u", "v"])


def _range_blocks(n: int) -> int:
    return int(min(MOST_BLOCKS, max(1, n**0.5 / BLOCK_ROOT * 2.0)))


def _meetings(built: DataFrame, radius: int) -> DataFrame:
    """Both blocks of every pair of blocks that may hold links, as two rows under the pair's name."""
    # One short row per block, of which there are at most MOST_BLOCKS.
    tops = built.select("block", "mask", "pattern").orderBy("block").collect()
    numbers = np.array([r["block"] for r in tops], dtype=np.int64)
    masks = np.array([r["mask"] for r in tops], dtype=np.int64).view(np.uint64)
    patterns = np.array([r["pattern"] for r in tops], dtype=np.int64).view(np.uint64)
    return built.select("block", "fps", "roots").mapInArrow(
        _partners(radius, masks, patterns, numbers), "first long, second long, block long, fps binary, roots binary"
    )


def linked(distinct: DataFrame, radius: int) -> DataFrame:
    """(node, root) for every fingerprint ``fp`` (distinct longs) that another is within ``radius`` bits of."""
    blocks = _range_blocks(ship(distinct).count())
    ranked = distinct.select("fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange(blocks, "rank")
    built = written(
        ranked.sortWithinPartitions("rank").select("fp").mapInArrow(_block_rows(radius), _BLOCK), "fp-blocks"
    )
    between = _meetings(built, radius).groupBy("first", "second").applyInPandas(_cross(radius), "u long, v long")
    inner = built.select("fps", "roots").mapInArrow(_inner_edges, "u long, v long")
    return connected_components(between.unionByName(inner))


# -- documents ----------------------------------------------------------------------


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def components(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of ``prints`` (doc_id, fp); the least doc_id reachable."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = written(linked(distinct.select("fp"), radius), "roots")
    members = distinct.join(roots, distinct["fp"] == roots["node"])
    least = members.groupBy("root").agg(F.min("least").alias("component"))
    named = members.select("fp", "root").join(least, "root").select(F.col("fp").alias("_fp"), "component")
    return distinct.join(named, F.col("fp") == F.col("_fp"), "left").select(
        "fp", F.coalesce("component", "least").alias("component_id")
    )


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Fingerprints link at ``radius`` or fewer differing bits.  Null and empty
    texts have fingerprint zero, linked like any other.  Rows with one text, or
    one doc_id, have their own rows; ``component_id`` is the least doc_id that
    is not null in the component, null if it has none.  An empty table gives no
    row.
    """
    prints = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words), "prints")
    named = written(components(prints, radius), "components")
    return prints.join(named, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def near_dedup(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row of every component of near copies, with all its columns: that with the least doc_id, nulls last.

    Components are those of ``near_duplicates``: fingerprints within ``radius``
    bits, chained.  Rows are grouped by the component's fingerprint and never
    by doc_id, which may be null or stand on several texts.  Rows known to be
    alone pass without a shuffle; of a larger component every task passes on its
    best row only.  An empty table stays empty.
    """
    rows = boxed(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text"))
    prints = written(fingerprints(rows.select("_row", "doc_id", "text"), words), "printed")
    sizes = written(prints.groupBy("fp").agg(F.count("*").alias("_rows")), "fp-sizes")
    roots = linked(sizes.select("fp"), radius).select(F.col("node").alias("_of"), "root")
    copied = sizes.where("_rows > 1").select(F.col("fp").alias("_of"), F.lit(None).cast("long").alias("root"))
    crowded = written(
        copied.unionByName(roots).groupBy("_of").agg(F.max("root").alias("root")).select("_of", F.coalesce("root", "_of").alias("root")),
        "crowded",
    )
    # At most SLOTS rows whatever the input.  Rows in no marked slot are alone and pass without a shuffle.
    slots = written(crowded.select(_slot(F.col("_of")).alias("_slot")).distinct(), "crowded-slots")
    marked = prints.join(F.broadcast(slots), _slot(F.col("fp")) == F.col("_slot"), "left")
    joined = marked.where("_slot IS NOT NULL").join(crowded.hint("merge"), F.col("fp") == F.col("_of"), "left")
    alone = marked.where("_slot IS NULL").select("_row").unionByName(joined.where("_of IS NULL").select("_row"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    best = joined.where("_of IS NOT NULL").groupBy("root").agg(F.min_by("_row", order).alias("_row"))
    return alone.unionByName(best.select("_row")).select("_row.*")
