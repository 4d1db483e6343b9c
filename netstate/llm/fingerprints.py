"""Document fingerprints by closed syncmers.

A k-mer of characters is chosen if the smallest of its inner substrings is its first or its last. That depends on the k-mer
alone, so an edit elsewhere never moves an anchor. A fingerprint keeps, in each of ``SLOTS`` slots, 16 bits of the smallest
anchor of that slot; two fingerprints are as alike as their sets of anchors. Anchors with positions align two texts.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.llm.texts import U64, Rolling, documents, mixed, spread
from netstate.session import materialize

K, S, SLOTS = 16, 5, 128
CHAR_VALUES = spread(4096, 3)


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the closed syncmers of a text; a text of under ``k`` characters is one anchor, '' has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) < k:
        whole = np.frombuffer(hashlib.sha256(text.encode()).digest()[:8], dtype=U64) if len(codes) else np.zeros(0, U64)
        return whole, np.zeros(len(whole), dtype=np.int64)
    roll = Rolling(mixed(codes.astype(U64) + U64(1)) if codes.max() >= len(CHAR_VALUES) else CHAR_VALUES[codes])
    inner = roll.windows(np.arange(len(codes) - s + 1), s)
    width, least, span = k - s + 1, inner, 1
    while span < width:                                            # minimum of ``width`` neighbours by doubling
        hop = min(span, width - span)
        least = np.minimum(least[:len(least) - hop], least[hop:])
        span += hop
    n = len(least)
    chosen = np.flatnonzero((inner[:n] == least) | (inner[width - 1:width - 1 + n] == least))
    return roll.windows(chosen, k), chosen


def fingerprint(text: str) -> str:
    """Hex of SLOTS 16-bit values, 'ffff' where a slot has no anchor. Equal texts have equal fingerprints."""
    hashes, _ = anchors(text)
    return _written(hashes)


def _written(hashes: np.ndarray) -> str:
    slots = np.full(SLOTS, 0xFFFFFFFFFFFFFFFF, dtype=U64)
    np.minimum.at(slots, (hashes % U64(SLOTS)).astype(np.int64), hashes)
    filled = slots != U64(0xFFFFFFFFFFFFFFFF)
    bits = np.where(filled, (mixed(slots) & U64(0xFFFF)) % U64(0xFFFF), U64(0xFFFF)).astype(">u2")
    return bits.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal slots among those that either fills; 1 if neither has any."""
    x, y = (np.frombuffer(bytes.fromhex(v), dtype=">u2") for v in (a, b))
    used = (x != 0xFFFF) | (y != 0xFFFF)
    return float((x[used] == y[used]).mean()) if used.any() else 1.0


def anchored(docs: DataFrame) -> DataFrame:
    """(doc_id, part, anchor, position): the syncmers of every text, for joins on the anchor and on position differences."""
    def run(batches):
        for batch in batches:
            for doc, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text"))):
                h, p = anchors(text or "")
                yield pa.record_batch({"doc_id": pa.array([doc] * len(h), pa.int64()), "part": pa.array([part] * len(h), pa.int32()),
                                       "anchor": pa.array(h.astype(np.int64), pa.int64()), "position": pa.array(p, pa.int64())})
    return documents(docs).mapInArrow(run, "doc_id bigint, part int, anchor bigint, position bigint")


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Anchors that two sets of ``anchored`` rows share, counted by documents and shift: positional matches."""
    r = right.toDF("other_id", "other_part", "anchor", "other_position")
    return left.join(r, "anchor").groupBy("doc_id", "other_id", (F.col("position") - F.col("other_position")).alias("shift")).count()


RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
STREAM = f"{RESULT}, slice int, edge string, text string"


def _compared(doc, text: str, own: str, following: str, their: str):
    half = len(text) // 2
    edited = text[:len(text) - half] + following[:half]
    theirs = fingerprint(edited)
    return (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, theirs, likeness(own, theirs), likeness(own, their))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, in which the next document's beginning replaces the second half.

    Next is the following row by descending doc_id (rows without an id last, equal ids in the order of a hash of their texts);
    after the last row comes the first. Rows are dealt out by ranges of the order, so each task streams its range; only the
    first and last text of a range are exchanged between neighbours. Texts travel compressed, and the keys that Spark samples
    to find the ranges are two numbers. Null texts count as empty; an empty table has no rows; other columns are not read.
    """
    def packed(batches):
        for batch in batches:
            blobs = [t.as_py().encode() for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array([len(b) for b in blobs], pa.int64()),
                                   pa.array([pa.compress(b, "zstd", asbytes=True) for b in blobs], pa.binary())],
                                  names=["doc_id", "mark", "size", "blob"])

    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(
        packed, "doc_id bigint, mark bigint, size bigint, blob binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark")]

    def run(batches):
        held, first, slice_ = None, None, TaskContext.get().partitionId()
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(),
                 pa.string()]
        names = [f.split()[0] for f in STREAM.split(", ")]

        def batch_of(rows):
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        out = []
        for batch in batches:
            for doc, size, blob in zip(batch.column("doc_id"), batch.column("size"), batch.column("blob")):
                text = pa.decompress(blob.as_buffer(), size.as_py(), "zstd", asbytes=True).decode()
                now = (doc.as_py(), text, fingerprint(text))
                if held is None:
                    first = now
                else:
                    out.append((*_compared(*held, *now[1:]), slice_, None, None))
                held = now
                if len(out) == 512:
                    yield batch_of(out)
                    out = []
        if held is not None:
            for edge, x in (("first", first), ("last", held)):
                out.append((x[0], None, None, x[2], None, None, None, slice_, edge, x[1]))
        yield batch_of(out)

    streamed = materialize(narrow.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, STREAM), "ranges")
    edges = streamed.where("edge is not null").select("slice", "edge", "doc_id", "text", "fingerprint")
    # one row for each range: as many as there are partitions
    slices = sorted(r["slice"] for r in edges.where("edge = 'first'").select("slice").collect())
    if not slices:
        return streamed.select(*[f.split()[0] for f in RESULT.split(", ")])
    following = dict(zip(slices, [*slices[1:], slices[0]]))
    spark = docs.sparkSession
    follows = spark.createDataFrame(list(following.items()), "slice int, next int")
    last = edges.where("edge = 'last'").join(F.broadcast(follows), "slice")
    first = edges.where("edge = 'first'").select(F.col("slice").alias("next"), F.col("text").alias("next_text"),
                                                 F.col("fingerprint").alias("next_fingerprint"))

    def close(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in RESULT.split(", ")]
        for batch in batches:
            rows = [_compared(*x) for x in zip(*(batch.column(c).to_pylist() for c in (
                "doc_id", "text", "fingerprint", "next_text", "next_fingerprint")))]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    closed = last.join(first, "next").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(close, RESULT)
    return streamed.where("edge is null").select(*closed.columns).union(closed)
