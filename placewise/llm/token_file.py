"""Token-id files in canonical length-limited Huffman code.

Documents are put in ascending order by one range shuffle, encoded, and cut
into blocks of whole documents.  Ids are counted over the whole table; the
counts, at most one per vocabulary entry, give one code for all blocks.  A
block decodes on its own: the bit offset of every ``LANE``-th id is kept, and
all lanes of a block are read in step through one lookup table.

A file set is a folder with two Parquet tables: ``codes`` (id, bits) and
``blocks`` (start, n_ids, doc_id[], n_tokens[], payload, lanes).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm.common import drop_written, scratch, ship, written
from placewise.llm.tokens import encoder

END_ID = 0
BLOCK_IDS = 1 << 16
LANE = 64
MAX_BITS = 18


# -- the code ---------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits per symbol of the best prefix code with no word longer than ``limit``.

    Package-merge: at every level pairs of the level below are merged with the
    symbols; a symbol's length is the number of levels at which it is among
    those taken.  Symbols without a count get no code.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    levels, row = [], weights
    is_symbol = np.ones(len(weights), dtype=bool)
    for _ in range(limit):
        levels.append(is_symbol)
        even = len(row) // 2 * 2
        packages = row[0:even:2] + row[1:even:2]
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        is_symbol, row = order < len(weights), both[order]
    taken = 2 * len(used) - 2
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:taken].sum())
        lengths[used[:symbols]] += 1
        taken = 2 * (min(taken, len(is_symbol)) - symbols)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words, counted upwards by (length, symbol)."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    if len(used):
        top = int(lengths.max())
        # Aligned to the longest word, each word starts where the one before ends.
        spans = np.uint64(1) << (top - lengths[used].astype(np.uint64))
        begins = np.cumsum(spans) - spans
        codes[used] = (begins >> (top - lengths[used].astype(np.uint64))).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every window of the longest word's bits: symbol << 5 | length."""
    top = int(lengths.max()) if len(lengths) else 0
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    entries = (used.astype(np.uint32) << np.uint32(5)) | lengths[used].astype(np.uint32)
    filled = np.repeat(entries, 1 << (top - lengths[used].astype(np.int64)))
    lookup = np.zeros(1 << top, dtype=np.uint32)
    lookup[: len(filled)] = filled
    return lookup, top


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The bits of the ids, high bit first, and the bit offset of every lane."""
    if not len(ids):
        return b"", b""
    bits = lengths.take(ids).astype(np.int64)
    ends = np.cumsum(bits)
    begins = ends - bits
    words = np.zeros(int(ends[-1] + 31 >> 5) + 1, dtype=np.uint64)
    # A word of up to 32 bits lies in at most two 32-bit cells; no two share a bit, so adding joins them.
    placed = codes.take(ids).astype(np.uint64)
    placed <<= (64 - bits - (begins & 31)).view(np.uint64)
    cell = begins >> 5
    first = np.flatnonzero(cell[1:] != cell[:-1]) + 1
    first = np.concatenate([[0], first])
    words[cell[first]] += np.add.reduceat(placed >> np.uint64(32), first)
    placed &= np.uint64(0xFFFFFFFF)
    words[cell[first] + 1] += np.add.reduceat(placed, first)
    payload = words.astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3)]
    return payload, begins[::LANE].astype("<u4").tobytes()


def unpack(payload: bytes, lanes: bytes, n_ids: int, lookup: np.ndarray, top: int) -> np.ndarray:
    """The ids of one block; all lanes advance together, one lookup per id."""
    if not n_ids:
        return np.zeros(0, dtype="<u4")
    raw = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    cells = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = np.frombuffer(lanes, dtype="<u4").astype(np.int64)
    out = np.empty((LANE, len(at)), dtype="<u4")
    down = np.uint32(32 - top)
    for step in range(LANE):
        # Lanes past the end of a block read its last cell.
        window = cells.take(at >> 3, mode="clip")
        window <<= (at & 7).astype(np.uint32)
        window >>= down
        entry = lookup.take(window)
        np.right_shift(entry, np.uint32(5), out=out[step])
        entry &= np.uint32(31)
        at += entry
    return out.T.reshape(-1)[:n_ids]


# -- the tables -------------------------------------------------------------------

_BLOCK = "part int, start_in_part long, n_ids long, doc_id array<long>, n_tokens array<long>, ids binary, counts binary"
_FILE = "start long, n_ids long, doc_id array<long>, n_tokens array<long>, payload binary, lanes binary"
_DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


def encoded_blocks(docs: DataFrame, vocabulary: str, spaced: bool = True) -> DataFrame:
    """Blocks of raw ids in ascending doc_id order; ``part`` numbers the ranges.

    Ids take two bytes where the vocabulary allows it.  The last block of a range
    has the counts of the range's ids, so that none of them is read to be counted.
    """
    ordered = (
        ship(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(vocabulary, spaced), TaskContext.get().partitionId()
        width = "<u2" if len(tool.edge) <= 1 << 16 else "<u4"
        total = np.zeros(len(tool.edge), dtype=np.int64)
        docs_, sizes, held, n, start, ready = [], [], [], 0, 0, None

        def block() -> list:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            np.add(total, np.bincount(ids, minlength=len(total)), out=total)
            return [part, start, len(ids), docs_, sizes, ids.astype(width).tobytes()]

        def row(block: list, counts: bytes | None) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip([*block, counts], kinds, strict=True)],
                names=["part", "start_in_part", "n_ids", "doc_id", "n_tokens", "ids", "counts"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if n >= BLOCK_IDS:
                    if ready:
                        yield row(ready, None)
                    ready = block()
                    docs_, sizes, held, n, start = [], [], [], 0, start + n
                ids = tool.ids(text.as_py())
                size = len(ids) // 4 + 1
                docs_.append(doc)
                sizes.append(size)
                held += ids, end
                n += size
        if ready:
            yield row(ready, None)
        if docs_:
            yield row(block(), total.tobytes())

    return ordered.mapInArrow(encode, _BLOCK)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell in batch.column(0):
            total = np.frombuffer(cell.as_buffer(), dtype=np.int64)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def write_token_file(docs: DataFrame, path: str, vocabulary: str, spaced: bool = True) -> None:
    """Writes the token ids of ``docs`` (doc_id, text), end id included, as a file set.

    A null or empty text is one end id; null doc_ids come first; rows that
    share a doc_id follow one another in an order fixed by their texts, and
    repeated rows are kept.  An empty table gives empty files.
    """
    spark = docs.sparkSession
    raw = written(encoded_blocks(docs, vocabulary, spaced), "token-blocks")
    # At most one row per vocabulary entry.
    counted = raw.where("counts IS NOT NULL").select("counts").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in counted), default=-1) + 1, dtype=np.int64)
    for row in counted:
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, max(MAX_BITS, int(len(counts)).bit_length()))
    codes = canonical(lengths)
    # One row per range of the shuffle.
    totals = raw.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    offsets = dict(zip([r["part"] for r in totals], np.cumsum([0, *[r["n"] for r in totals]]).tolist()))

    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, n, doc, sizes, ids = (batch.column(c)[i] for c in range(6))
                data = ids.as_buffer()
                found = np.frombuffer(data, dtype="<u2" if data.size == 2 * n.as_py() else "<u4")
                payload, lanes = pack(found, codes, lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([offsets[part.as_py()] + start.as_py()], pa.int64()), pa.array([len(found)], pa.int64()),
                     batch.column(3).slice(i, 1), batch.column(4).slice(i, 1), pa.array([payload], pa.binary()),
                     pa.array([lanes], pa.binary())],
                    names=["start", "n_ids", "doc_id", "n_tokens", "payload", "lanes"],
                )

    used = np.flatnonzero(lengths)
    book = [(int(i), int(lengths[i])) for i in used]
    spark.createDataFrame(book, "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    # The payload is already dense.
    raw.drop("counts").mapInArrow(squeeze, _FILE).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_written(raw)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids as little-endian unsigned 32-bit integers."""
    book = spark.read.schema("id long, bits int").parquet(f"{path}/codes").collect()  # at most the vocabulary
    lengths = np.zeros(max((r["id"] for r in book), default=-1) + 1, dtype=np.uint8)
    for row in book:
        lengths[row["id"]] = row["bits"]
    lookup, top = decode_table(lengths)

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, n_ids, docs, sizes, payload, lanes = (batch.column(c)[i] for c in range(6))
                data = unpack(payload.as_py(), lanes.as_py(), n_ids.as_py(), lookup, top).tobytes()
                n = sizes.values.to_numpy()
                ends = np.cumsum(n)
                places = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(start.as_py() + ends - n), pa.array(n),
                     pa.Array.from_buffers(pa.binary(), len(n), [None, places, pa.py_buffer(data)])],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return spark.read.schema(_FILE).parquet(f"{path}/blocks").mapInArrow(expand, _DOCUMENT)


def token_file(docs: DataFrame, vocabulary: str, spaced: bool = True, path: str | None = None) -> DataFrame:
    """Writes the file set, in the shared folder if no path is given, and reads it back."""
    path = path or scratch(docs.sparkSession, "token-file")
    write_token_file(docs, path, vocabulary, spaced)
    return read_token_file(docs.sparkSession, path)
