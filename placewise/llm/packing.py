"""Best-fit packing of token documents by swap-based local search.

Documents are tokenised once and cut into pieces of at most ``CAPACITY`` ids.
Pieces are dealt by hash into chunks of about ``CHUNK`` rows; each chunk packs
its narrow rows (no ids) on its own and keeps only its loosest bins open.  Next
fit is the start; pieces then move between underfull bins, or are exchanged one
for one, two for one and one for two, so that squared fill rises and bins empty.  The
open bins of ``MERGE`` chunks meet in the next level, until one chunk is left.
So little room is lost between chunks.  What goes on is bounded in bins and in
pieces: a task of a higher level gets at most ``MERGE`` x (``OPEN_PIECES`` +
``CAPACITY``) rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import ship, written
from placewise.llm.tokens import encoder

CAPACITY = 2048
CHUNK = 32_768
OPEN_BINS = 256
OPEN_PIECES = 8192
MERGE = 64
#: Of the longest pieces of a bin so many may move or give way two at a time.
PAIRED = 8
END_ID = 0


# -- one chunk --------------------------------------------------------------------


class Bins:
    """Bins of one chunk, with the moves of the local search."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []  # (length, item)
        self.fill: list[int] = []
        self.moves = 0

    def put(self, bin_: int, entries: Iterable[tuple[int, int]]) -> None:
        """Adds entries to a bin, opening bins up to it."""
        while len(self.items) <= bin_:
            self.items.append([])
            self.fill.append(0)
        for entry in entries:
            self.items[bin_].append(entry)
            self.fill[bin_] += entry[0]

    def next_fit(self, entries: Iterable[tuple[int, int]]) -> None:
        """As they come: each into the last bin, or into a new one if it does not fit."""
        for entry in entries:
            last = len(self.items) - 1
            self.put(last if last >= 0 and self.fill[last] + entry[0] <= self.capacity else last + 1, [entry])

    def best_fit(self, entries: Iterable[tuple[int, int]]) -> None:
        """Longest first, each into the bin it leaves least room in."""
        rooms: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        seen = 0  # bit r is set if some bin has room r
        for size, item in sorted(entries, key=lambda e: -e[0]):
            fitting = seen >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                bin_ = rooms[room].pop()
                if not rooms[room]:
                    seen &= ~(1 << room)
            else:
                room, bin_ = self.capacity, len(self.items)
            self.put(bin_, [(size, item)])
            room -= size
            if room:
                rooms[room].append(bin_)
                seen |= 1 << room

    # Index of what the underfull bins can take: n pieces of b ids together in a bin with
    # room r give way to anything of up to b + r; an empty place has b = 0.  Places are
    # held by b + r, then by (b, n), so bins alike cost one look.
    def _places(self, bin_: int) -> list[tuple[int, tuple[int, int], tuple[int, ...]]]:
        room = self.capacity - self.fill[bin_]
        if not room:
            return []
        sizes = sorted((s for s, _ in self.items[bin_]), reverse=True)
        backs: list[tuple[int, ...]] = [(), *[(s,) for s in dict.fromkeys(sizes)]]
        backs += dict.fromkeys(combinations(sizes[:PAIRED], 2))
        return [(sum(back) + room, (sum(back), len(back)), back) for back in backs]

    def _enter(self, bin_: int) -> None:
        for size, kind, back in self._places(bin_):
            self.reach.setdefault(size, {}).setdefault(kind, {})[(bin_, back)] = None
            self.reaches |= 1 << size

    def _leave(self, bin_: int) -> None:
        for size, kind, back in self._places(bin_):
            kinds = self.reach[size]
            del kinds[kind][(bin_, back)]
            if not kinds[kind]:
                del kinds[kind]
                if not kinds:
                    del self.reach[size]
                    self.reaches &= ~(1 << size)

    def _target(self, length: int, source: int, most: int) -> tuple[int, tuple[int, ...]] | None:
        """The place where ``length`` leaves least room and squared fill grows: bin, and at most so many lengths given back."""
        # The taker ends with ``step`` of room, less than the source has now.
        ahead = (self.reaches >> length) & ((1 << self.capacity - self.fill[source]) - 1)
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            for (given, n), places in self.reach[length + step].items():
                if given < length and n <= most:
                    found = next((place for place in places if place[0] != source), None)
                    if found:
                        return found
            ahead &= ahead - 1
        return None

    def _swap(self, source: int, out: tuple[int, ...], bin_: int, back: tuple[int, ...]) -> None:
        self._leave(source)
        self._leave(bin_)
        for giver, taker, lengths in ((source, bin_, out), (bin_, source, back)):
            for size in lengths:
                entry = next(e for e in self.items[giver] if e[0] == size)
                self.items[giver].remove(entry)
                self.fill[giver] -= size
                self.put(taker, [entry])
        self._enter(source)
        self._enter(bin_)
        self.moves += 1

    def _one_move(self, source: int) -> bool:
        sizes = sorted((s for s, _ in self.items[source]), reverse=True)
        # Move one, or exchange it for one or two.
        for size in dict.fromkeys(sizes):
            found = self._target(size, source, 2)
            if found:
                self._swap(source, (size,), *found)
                return True
        # Move two, or exchange them for one.
        for two in dict.fromkeys(combinations(sizes[:PAIRED], 2)):
            found = self._target(sum(two), source, 1)
            if found:
                self._swap(source, two, *found)
                return True
        return False

    def _climb(self, least: int) -> None:
        """Takes from the emptiest bins until no move is left or ``least`` bins are.

        A move puts more into a bin that ends fuller than its source was, so
        squared fill rises with each and the climb ends.
        """
        while True:
            live = [b for b in range(len(self.items)) if self.items[b]]
            used, before = len(live), self.moves
            self.reach: dict[int, dict[tuple[int, int], dict[tuple[int, tuple[int, ...]], None]]] = {}
            self.reaches = 0  # bit v is set if ``reach`` has v
            for b in live:
                self._enter(b)
            for source in sorted(live, key=self.fill.__getitem__):
                if used <= least:
                    return
                while self.items[source] and self.fill[source] < self.capacity and self._one_move(source):
                    pass
                used -= not self.items[source]
            if self.moves == before:
                return

    def search(self, anew: bool = True) -> None:
        """Climbs; where more bins are left than any packing needs, best fit deals the loosest anew, and the climb goes on.

        The loosest 64 bins are dealt anew, then twice as many, up to all.  What
        is dealt anew is taken only if it fills fewer bins.
        """
        least = fewest_bins([s for held in self.items for s, _ in held], self.capacity)
        self._climb(least)
        some = 64
        while True:
            live = sorted((b for b in range(len(self.items)) if self.items[b]), key=self.fill.__getitem__)
            if len(live) <= least or not anew:
                return
            loose, fresh = live[:some], Bins(self.capacity)
            fresh.best_fit([entry for b in loose for entry in self.items[b]])
            if len(fresh.items) < len(loose):
                for b in loose:
                    self.items[b], self.fill[b] = [], 0
                for b, held in zip(loose, fresh.items, strict=False):
                    self.put(b, held)
                self._climb(least)
            elif some >= len(live):
                return
            else:
                some *= 2


def fewest_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: items over half a bin never share one, nor do they with what does not fit beside them."""
    count = np.bincount(sizes, minlength=capacity + 1)
    weight = count * np.arange(capacity + 1)
    n, w = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(weight)])
    half = capacity // 2
    best = -(-int(w[-1]) // capacity)
    for k in range(0, half + 1):
        wide, middle = int(n[-1] - n[capacity - k + 1]), int(n[capacity - k + 1] - n[half + 1])
        room = middle * capacity - int(w[capacity - k + 1] - w[half + 1])
        best = max(best, wide + middle + max(0, -(-(int(w[half + 1] - w[k]) - room) // capacity)))
    return best


def pack_lengths(
    sizes: list[int], capacity: int = CAPACITY, held: np.ndarray | None = None, anew: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and fill of it for every length; gapless, bins numbered from 0.

    The search starts from the packing whose bins ``held`` numbers, or from next
    fit in the order given.  ``anew``: bins that the search can't empty may be dealt anew.
    """
    bins = Bins(capacity)
    if held is None:
        bins.next_fit((size, item) for item, size in enumerate(sizes))
    else:
        for item, (size, b) in enumerate(zip(sizes, held.tolist(), strict=True)):
            bins.put(b, [(size, item)])
    bins.search(anew)
    which, offset, fill = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
    for number, b in enumerate(b for b in range(len(bins.items)) if bins.items[b]):
        at = 0
        for size, item in bins.items[b]:
            which[item], offset[item], fill[item] = number, at, bins.fill[b]
            at += size
    return which, offset, fill


# -- tables -----------------------------------------------------------------------

_PIECE = "piece_id long, doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, spaced: bool = False) -> DataFrame:
    """Pieces of every document with their ids, little-endian unsigned 32-bit; written, as encoding is dear."""
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary, spaced)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                doc_ids, numbers, starts, lengths, ids = [], [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    data = tool.ids(text.as_py()) + end
                    for number, at in enumerate(range(0, len(data), 4 * capacity)):
                        doc_ids.append(doc)
                        numbers.append(number)
                        starts.append(at // 4)
                        ids.append(data[at : at + 4 * capacity])
                        lengths.append(len(ids[-1]) // 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    cut_up = ship(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECE.split(", ", 1)[1])
    return written(cut_up.select(F.monotonically_increasing_id().alias("piece_id"), "*"), "pieces")


def place(narrow: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a unique ``piece_id`` and a ``length`` of 1 to ``capacity``.

    A piece of full length is a sequence by itself.  Sequence ids are unique,
    negative for full pieces, and say nothing else.
    """
    columns = ship(narrow).columns
    full = narrow.where(F.col("length") == capacity).select(
        "*", (-1 - F.col("piece_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = narrow.where(F.col("length") < capacity)
    chunks = max(1, -(-rest.count() // chunk))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema) + (
        ", _chunk long, _held long, sequence_id long, offset long, _open boolean"
    )

    def packed(level: int, last: bool):
        def pack_chunk(rows: pd.DataFrame) -> pd.DataFrame:
            # A random order that a retry finds again: pieces may come sorted by length.
            mixed = rows["piece_id"].to_numpy(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            rows = rows.iloc[np.argsort(mixed, kind="stable")].reset_index(drop=True)
            held = rows["_held"].rank(method="dense").to_numpy(dtype=np.int64) - 1 if level else None
            which, offset, fill = pack_lengths(rows["length"].tolist(), capacity, held, last)
            # Only so many of the loosest bins go on, and no full ones; the others stay as they are.
            by_bin = pd.DataFrame({"fill": fill, "bin": which}).groupby("bin")["fill"].agg(["first", "size"])
            by_bin = by_bin[by_bin["first"] < capacity].sort_values("first", kind="stable").iloc[: 0 if last else OPEN_BINS]
            loose = by_bin.index[by_bin["size"].cumsum() - by_bin["size"] < OPEN_PIECES]
            number = int(rows["_chunk"].iloc[0])
            sequence = (level << 58) + (number << 24) + which
            return rows.assign(_held=sequence, sequence_id=sequence, offset=offset, _open=np.isin(which, loose))

        return pack_chunk

    current = rest.select(
        "*", F.pmod(F.xxhash64("piece_id"), F.lit(chunks)).cast("long").alias("_chunk"), F.lit(0).cast("long").alias("_held")
    )
    done, level = full, 0
    while True:
        last = chunks == 1
        current = current.select(*columns, "_chunk", "_held")
        result = written(current.groupBy("_chunk").applyInPandas(packed(level, last), schema), "packed")
        done = done.unionByName(result.where("NOT _open").select(*columns, "sequence_id", "offset"))
        if last:
            return done
        current = result.where("_open").withColumn("_chunk", F.floor(F.col("_chunk") / MERGE).cast("long"))
        chunks, level = -(-chunks // MERGE), level + 1


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, spaced: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    A null or empty text is one end id.  Documents longer than ``capacity`` are
    cut, others never.  Repeated rows and ties are packed each for itself; an
    empty table gives no row.
    """
    cut_up = pieces(docs, vocabulary, capacity, spaced)
    narrow = cut_up.select("piece_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(narrow, capacity).drop("piece_id")


def sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, spaced: bool = False) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids): the packed sequences themselves; a sequence is at most ``capacity`` ids."""
    cut_up = pieces(docs, vocabulary, capacity, spaced)
    placed = place(cut_up.select("piece_id", "length"), capacity).select("piece_id", "sequence_id", "offset")
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids", "length")))
    return (
        cut_up.join(placed, "piece_id")
        .groupBy("sequence_id")
        .agg(held.alias("held"))
        .select(
            "sequence_id",
            F.aggregate("held.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"),
            F.col("held.doc_id").alias("doc_ids"),
            F.aggregate("held.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
        )
    )
