"""Token ids in patched frame-of-reference blocks.

A segment holds consecutive documents' ids in blocks of ``BLOCK``: the block's minimum is subtracted, what remains is
packed at the width that holds 90 % of its values, the high bits of the others go to an exception list, and an index
has every block's start. A segment can be read from any block on. Segments are rows of Parquet files, the one binary
container that Spark writes to any store: part (order of the files), segment, n_docs, n_ids, data.

A segment's bytes, little-endian: magic "HPF1", n_docs u32, n_ids u64, n_blocks u32; per document its doc_id i64, null
flag u8 and number of ids u32; per block its minimum u32, width u8, number of exceptions u16 and the start of its
payload u32; payloads, each a block's packed values; exceptions, block by block: places u8, then high bits u32.

Nulls: a null text is empty and has the end id alone; rows without doc_id come first; rows that share one are each written,
in any order. Texts of any length are encoded whole; one longer than a segment is a segment of its own. An empty table
writes no segment and reads back as no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.chunks import encoder, slices, tidy
from halyard.llm.common import scratch

BLOCK, PERCENTILE, SEGMENT_IDS = 128, 90, 1 << 20
GENERATION = 800_000  # chunks that a worker keeps: nothing else runs beside this
MAGIC = b"HPF1"
ROWS = "part int, segment long, at long, n_docs long, n_ids long, data binary"


def pack(ids: np.ndarray) -> tuple[bytes, int]:
    """Blocks of ``ids`` (unsigned 32-bit): index, payloads and exceptions; the number of blocks."""
    n = -(-len(ids) // BLOCK)
    values = np.empty(n * BLOCK, np.uint32)
    values[: len(ids)] = ids
    values[len(ids) :] = ids[-1] if len(ids) else 0
    values = values.reshape(n, BLOCK)
    low = values.min(axis=1)
    rest = values - low[:, None]
    width = bits(rest.max(axis=1)) if n else np.zeros(0, np.uint8)
    open_ = np.flatnonzero(width)
    while len(open_):  # one bit less while that leaves few enough values over
        less = (width[open_] - 1).astype(np.uint32)
        few = (rest[open_] >> less[:, None] != 0).sum(axis=1) <= BLOCK - BLOCK * PERCENTILE // 100
        open_ = open_[few]
        width[open_] -= 1
        open_ = open_[width[open_] > 0]
    over = np.zeros_like(rest)
    narrow = np.flatnonzero(width < 32)
    over[narrow] = rest[narrow] >> width[narrow, None].astype(np.uint32)
    blocks, places = np.nonzero(over)
    start, payload, at = np.zeros(n, np.int64), [], 0
    for w in np.unique(width[width > 0]):  # payloads of one width stand together
        own = np.flatnonzero(width == w)
        packed = packed_rows(rest[own] & np.uint32((1 << int(w)) - 1), int(w))
        start[own] = at + np.arange(len(own)) * packed.shape[1]
        at += packed.size
        payload.append(packed.tobytes())
    index = np.empty(n, _INDEX)
    index["low"], index["width"], index["start"] = low, width, start
    index["exceptions"] = np.bincount(blocks, minlength=n)
    return index.tobytes() + b"".join(payload) + places.astype(np.uint8).tobytes() + over[blocks, places].astype("<u4").tobytes(), n


def packed_rows(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of ``BLOCK`` values of ``w`` bits as bytes, the first bits first: 8 values make w bytes."""
    if w > 16:
        raw = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(len(values), BLOCK, 4), axis=2)
        return np.packbits(raw[:, :, 32 - w :].reshape(len(values), -1), axis=1)
    v = values.reshape(len(values), BLOCK // 8, 2, 4).astype(np.uint64)
    four = (v[..., 0] << np.uint64(3 * w)) | (v[..., 1] << np.uint64(2 * w)) | (v[..., 2] << np.uint64(w)) | v[..., 3]
    two = np.empty(four.shape, ">u8")  # the 8 values' bits at the end of 16 bytes
    two[..., 0] = four[..., 0] if w == 16 else four[..., 0] >> np.uint64(64 - 4 * w)
    two[..., 1] = four[..., 1] if w == 16 else (four[..., 0] << np.uint64(4 * w)) | four[..., 1]
    return two.view(np.uint8).reshape(len(values), BLOCK // 8, 16)[:, :, 16 - w :].reshape(len(values), -1)


def unpacked_rows(raw: np.ndarray, w: int) -> np.ndarray:
    """The rows that ``packed_rows`` made into bytes."""
    if w > 16:
        wide = np.zeros((len(raw), BLOCK, 32), np.uint8)
        wide[:, :, 32 - w :] = np.unpackbits(raw, axis=1).reshape(len(raw), BLOCK, w)
        return np.packbits(wide, axis=2).reshape(len(raw), -1).view(">u4").astype(np.uint32)
    wide = np.zeros((len(raw), BLOCK // 8, 16), np.uint8)
    wide[:, :, 16 - w :] = raw.reshape(len(raw), BLOCK // 8, w)
    two = wide.view(">u8").astype(np.uint64)
    four = two.copy()
    if w < 16:
        four[..., 0] = (two[..., 0] << np.uint64(64 - 4 * w)) | (two[..., 1] >> np.uint64(4 * w))
    out = np.empty((*two.shape, 4), np.uint32)
    mask = np.uint64((1 << w) - 1)
    for k in range(4):
        out[..., k] = (four >> np.uint64((3 - k) * w)) & mask
    return out.reshape(len(raw), -1)


_INDEX = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("start", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u4")])


def bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def unpack(data: bytes, n_blocks: int, n_ids: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks ``first`` to ``last``, found through the index."""
    index = np.frombuffer(data, _INDEX, n_blocks)
    last = n_blocks if last is None else last
    at = n_blocks * _INDEX.itemsize
    total = int((index["width"].astype(np.int64) * (BLOCK // 8)).sum())
    payload = np.frombuffer(data, np.uint8, total, at)
    counts = index["exceptions"].astype(np.int64)
    ends = np.cumsum(counts)
    places = np.frombuffer(data, np.uint8, int(counts.sum()), at + total)
    high = np.frombuffer(data, "<u4", int(counts.sum()), at + total + len(places))
    own = index[first:last]
    out = np.zeros((len(own), BLOCK), np.uint32)
    for w in np.unique(own["width"][own["width"] > 0]):
        rows = np.flatnonzero(own["width"] == w)
        size, begins = int(w) * (BLOCK // 8), own["start"][rows].astype(np.int64)
        if (np.diff(begins) == size).all():
            raw = payload[begins[0] : begins[-1] + size].reshape(len(rows), size)
        else:
            raw = payload[begins[:, None] + np.arange(size)]
        out[rows] = unpacked_rows(raw, int(w))
    lo, hi = int(ends[first - 1]) if first else 0, int(ends[last - 1]) if last else 0
    blocks = np.repeat(np.arange(len(own)), counts[first:last])
    width = own["width"][blocks].astype(np.uint32)
    out[blocks, places[lo:hi]] |= high[lo:hi] << width
    out += own["low"][:, None]
    return out.ravel()[: n_ids - first * BLOCK]


def segment(docs: list, counts: list[int], ids: np.ndarray) -> bytes:
    table = np.zeros(len(docs), _DOC)
    table["null"] = [d is None for d in docs]
    table["doc_id"] = [d or 0 for d in docs]
    table["n"] = counts
    body, n_blocks = pack(ids)
    return MAGIC + struct.pack("<IQI", len(docs), len(ids), n_blocks) + table.tobytes() + body


def parse(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A segment's documents and all its ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n_docs, n_ids, n_blocks = struct.unpack_from("<IQI", data, 4)
    table = np.frombuffer(data, _DOC, n_docs, 20)
    return table, unpack(data[20 + n_docs * _DOC.itemsize :], n_blocks, n_ids)


def write(docs: DataFrame, path: str, out: str, end_id: int = 2, parts: int | None = None) -> None:
    """Encode every row's text, append ``end_id``, and write all ids in ascending doc_id order under ``out``.

    Rows are range-partitioned by doc_id, null first, so each part holds a range and no part depends on another; rows
    that share a doc_id are told apart by where they stand in the input, so that a hot doc_id spreads over parts.
    """
    parts = parts or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        coder, part, number, total = encoder(path, GENERATION), TaskContext.get().partitionId(), 0, 0
        names, counts, raws, n = [], [], [], 0

        def closed() -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(raws), "<u4")
            row = [[part], [number], [total], [len(names)], [len(raw)], [segment(names, counts, raw)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "segment", "at", "n_docs", "n_ids", "data"])

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                for name, raw in zip(batch.column(0).slice(at, len(texts)).to_pylist(), coder.encode(texts), strict=True):
                    raws.append(np.frombuffer(raw, coder.dtype).astype("<u4").tobytes() + end)
                    names.append(name)
                    counts.append(len(raws[-1]) // 4)
                    n += counts[-1]
                    if n >= SEGMENT_IDS:
                        yield closed()
                        total, number = total + n, number + 1
                        names, counts, raws, n = [], [], [], 0
        if names:
            yield closed()
        tidy()

    keyed = docs.select("doc_id", "text").withColumn("at", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(parts, "doc_id", "at").sortWithinPartitions("doc_id", "at")
    ranged.select("doc_id", "text").mapInArrow(encode, ROWS).write.option("compression", "uncompressed").parquet(out)


def read(spark, place: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, decoded from its blocks."""
    files = spark.read.schema(ROWS).parquet(place)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each part
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["n"]
    first = spark.createDataFrame(starts, "part int, before long")

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table, ids = parse(data.as_buffer().to_pybytes())
                ends = np.cumsum(table["n"].astype(np.int64))
                begins = ends - table["n"]
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                names = pa.array(table["doc_id"].astype(np.int64), mask=table["null"].astype(bool))
                yield pa.RecordBatch.from_arrays([names, pa.array(begins + base), pa.array(table["n"].astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    met = files.select("part", "at", "data").join(F.broadcast(first), "part").select((F.col("before") + F.col("at")).alias("first"), "data")
    return met.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    out = scratch(docs.sparkSession, "tokens")
    write(docs, path, out, end_id)
    return read(docs.sparkSession, out)
