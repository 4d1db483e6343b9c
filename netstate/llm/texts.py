"""Documents as rows of (doc_id, part, text), and vectorised hashing of bytes and words inside tasks."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

U64 = np.uint64
ODD, ODD2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BLOCK_BYTES = 1 << 21


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``part``, ``text`` and the columns ``more``; other columns are left behind.

    ``part`` is 0, but where rows share a doc_id (null ids included) it numbers them in the order of their texts, so that
    (doc_id, part) names a row. Whether ids repeat is found by counting the narrow ids.
    """
    narrow = docs.select("doc_id", "text", *more)
    again = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return narrow.withColumn("part", F.lit(0))
    order = Window.partitionBy("doc_id").orderBy("text")
    return narrow.withColumn("part", F.row_number().over(order) - 1)


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``user``: all other columns as one, so that no name of theirs meets one of an operator."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("there"), *fields).alias("user"))


def unpacked(names: list[str], text: Column | None = None) -> list[Column]:
    """The columns ``names`` of the table that was packed, in their order; ``text`` takes the place of the text."""
    others = [c for c in names if c not in ("doc_id", "text")]
    kept = {"doc_id": F.col("doc_id"), "text": F.col("text") if text is None else text}
    kept |= {c: F.col("user").getField(f"c{i}") for i, c in enumerate(others)}
    return [kept[n].alias(n) for n in names]


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (doc_id, part, text in UTF-8) of at most ``most`` bytes, or one longer text."""
    rows, size = [], 0
    for batch in batches:
        ids, parts, texts = batch.column("doc_id"), batch.column("part"), batch.column("text").cast(pa.large_binary())
        for i, p, t in zip(ids.to_pylist(), parts.to_pylist(), texts):
            t = t.as_py() or b""
            if rows and size + len(t) > most:
                yield rows
                rows, size = [], 0
            rows.append((i, p, t))
            size += len(t)
    if rows:
        yield rows


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def spread(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=U64) * U64(ODD) + U64(seed))


_POWERS: dict[tuple, np.ndarray] = {}


def powers(base: int, n: int, kind=U64) -> np.ndarray:
    """base^0 to base^(n - 1) modulo the width of ``kind``; the longest asked for is kept."""
    known = _POWERS.get((base, kind))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base & (2 ** (8 * np.dtype(kind).itemsize) - 1), dtype=kind)
        known[0] = 1
        known = _POWERS[base, kind] = np.multiply.accumulate(known, dtype=kind)
    return known[:n]


class Rolling:
    """Hashes of windows of a sequence: sums of value x base^position modulo 2^64 (or 2^32), moved to position 0."""

    def __init__(self, values: np.ndarray, base: int = ODD):
        n, kind = len(values), values.dtype.type
        self.sums = np.zeros(n + 1, dtype=kind)
        np.cumsum(values * powers(base, n, kind), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n + 1, kind)

    def windows(self, starts: np.ndarray, length) -> np.ndarray:
        out = (self.sums[starts + length] - self.sums[starts]) * self.back[starts]
        return mixed(out) if out.dtype == U64 else out


BYTE_VALUES, BYTE_VALUES2 = spread(256, 1), spread(256, 2).astype(np.uint32)


class Block:
    """Texts of a block side by side; offsets hold where each begins."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        self.rows = rows
        self.bytes = np.frombuffer(b"".join(t for _, _, t in rows), dtype=np.uint8)
        self.offsets = np.zeros(len(rows) + 1, dtype=np.int64)
        np.cumsum([len(t) for _, _, t in rows], out=self.offsets[1:])
        self.ids = np.array([-1 if i is None else i for i, _, _ in rows], dtype=np.int64)
        self.parts = np.array([p for _, p, _ in rows], dtype=np.int64)

    def words(self, lower: bool = False) -> "Words":
        return Words(self, lower)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Runs of bytes other than blank and 0x09-0x0D: hash, document and index within it of every word."""

    def __init__(self, block: Block, lower: bool):
        text, offsets = block.bytes, block.offsets
        text = LOWER[text] if lower else text
        inside = (text != 32) & ((text < 9) | (text > 13))
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = offsets[1:] > offsets[:-1]
        begin, end = offsets[:-1][filled], offsets[1:][filled] - 1
        first[begin] |= inside[begin]
        last[end] |= inside[end]
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(last) + 1
        self.hash = Rolling(BYTE_VALUES[text]).windows(starts, ends - starts)
        self.bounds = np.searchsorted(starts, offsets)            # words of row r: bounds[r] to bounds[r + 1]
        self.row = np.repeat(np.arange(len(block.rows)), np.diff(self.bounds))
        self.index = np.arange(len(starts)) - self.bounds[self.row]
        self.count = np.diff(self.bounds)

    def windows_starting(self, length: int) -> np.ndarray:
        """Words at which a window of ``length`` words of one document begins."""
        return np.flatnonzero(self.index + length <= self.count[self.row])
