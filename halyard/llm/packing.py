"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Bins depend on lengths alone, so the plan is made from the
histogram of lengths, which has at most ``capacity`` entries however large the input is: a bin starts with the longest
length left, and a bitset subset-sum over the lengths left finds the fullest combination for the rest of it. The
combination is taken as often as the counts allow and removed. Pieces are then numbered within their length, hot
lengths in salted parts, and each looks its bin up by length and number.

A plan has at most a few entries for each length (a combination, taken as often as possible, at least halves the count
of one of its lengths), so it is small enough to be sent to every task.

Nulls: a null text is empty and makes one piece of the end token; doc_id may be null or repeated. An empty table packs
into nothing. Texts of any length are encoded whole, one at a time, and cut into pieces only where they exceed the
capacity. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.chunks import encoder, slices, tidy
from halyard.llm.common import checkpointed

#: Chunks that a worker keeps: other stages' workers may be idle beside it.
GENERATION = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Per piece of every row's text: doc_id, piece, start, length, ids_crc32 [, ids]. One pass, no shuffle."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = encoder(path, GENERATION)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names = batch.column(0)
            for at, texts in slices(batch.column(1)):
                rows, starts, lengths, crcs, kept = [], [], [], [], []
                for k, raw in enumerate(coder.encode(texts)):
                    ids = np.frombuffer(raw, coder.dtype).astype("<u4").tobytes() + end
                    for start in range(0, len(ids), 4 * capacity):
                        part = ids[start : start + 4 * capacity]
                        rows.append(k)
                        starts.append(start // 4)
                        lengths.append(len(part) // 4)
                        crcs.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(np.frombuffer(part, "<u4").astype(np.int64))
                place = np.array(starts, np.int64)
                columns = [names.slice(at, len(texts)).take(pa.array(rows, pa.int64())), pa.array((place // capacity).astype(np.int32)), pa.array(place), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                extra = [pa.array(kept, pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns + extra, ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids array<long>" * with_ids)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths that fills ``room`` best: (length, how many), longest lengths first.

    Bit s of ``reach`` says that sum s is feasible; the search ends once ``room`` itself is.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        n, k = min(counts[length], room // length), 1
        while n > 0:  # 1, 2, 4 ... copies at once make every number up to n
            k = min(k, n)
            steps.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            n -= k
            k *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + k
            at -= length * k
    return sorted(chosen.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for ``histogram``: combinations as (length, how many) and how many bins have each."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        found = dict(fullest(counts, lengths, capacity - longest))
        counts[longest] += 1
        found[longest] = found.get(longest, 0) + 1
        times = min(counts[k] // m for k, m in found.items())
        out.append((sorted(found.items(), reverse=True), times))
        for k, m in found.items():
            counts[k] -= m * times
        if any(not counts[k] for k in found):
            lengths = [k for k in lengths if counts[k]]
    return out


def slots(bins: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Where each run of a length's numbers goes: length, first number, first bin, how many in a bin, first offset."""
    rows, used, first = [], {}, 0
    for found, times in bins:
        offset = 0
        for length, m in found:
            rows.append((length, used.get(length, 0), first, m, offset))
            used[length] = used.get(length, 0) + m * times
            offset += length * m
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(found: DataFrame, counts: dict[int, int], part: int = 2_000) -> DataFrame:
    """``found`` with each row's number within its length. A length's rows are dealt into parts of about ``part``."""
    hot = [(k, -(-n // part)) for k, n in counts.items() if n > part]
    parts = F.lit(1)
    if hot:  # a row for each length at most
        table = found.sparkSession.createDataFrame(hot, "l long, parts long")
        found, parts = found.join(F.broadcast(table), F.col("length") == F.col("l"), "left"), F.coalesce("parts", F.lit(1))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), parts))
    salted = checkpointed(salted.drop("l", "parts")) if hot else salted
    own = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1)
    if not hot:
        return own.drop("salt")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(before, F.lit(0)).alias("before"))
    met = own.join(first, (own["length"] == first["l"]) & (own["salt"] == first["s"]))
    return met.withColumn("rank", F.col("rank") + F.col("before")).drop("l", "s", "before", "salt")


def packed(found: DataFrame, capacity: int = 4096) -> DataFrame:
    """``found`` (pieces) with each piece's sequence_id and offset there."""
    found = checkpointed(found)
    counts = {int(r["length"]): r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = found.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        runs = table.value
        keys = (runs[:, 0] << 40) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, (length << 40) + rank, side="right") - 1]
            own = rank - run[:, 1]
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(run[:, 2] + own // run[:, 3]), pa.array(run[:, 4] + own % run[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = ranked(found, counts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return numbered.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return packed(pieces(docs, path, capacity, end_id), capacity)
