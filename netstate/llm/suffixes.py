"""Suffix dedup on bytes: difference cover and one suffix bucket at a time.

A difference cover modulo 73 has 9 residues such that any two positions of the corpus have a common shift below 73 that
takes both into the cover. So of two equal strings of 100 bytes, equal strings of 28 bytes begin at a covered position at the
same shift. First the covered suffixes are grouped by their 28 bytes: that is the cover's rank as far as it matters here, and
it leaves only suffixes near covered positions whose class has several members. Then those suffixes are ordered by their first
100 bytes, one bucket of suffixes after the other, so that what is held and shuffled at a time is a bucket and not the corpus.
Within a bucket, order and ties are settled by 80-bit fingerprints of the 100 bytes instead of a walk through long common
prefixes; all that is asked of the order is that equal strings are neighbours and the first occurrence comes first.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.llm import postings
from netstate.llm.texts import BYTE_VALUES, BYTE_VALUES2, ODD2, U64, Block, Rolling, blocks, documents
from netstate.session import discard, materialize

LENGTH = 100
#: A perfect difference set; every nonzero residue modulo 73 is a difference of exactly one pair.
COVER_PERIOD, COVER = 73, (0, 1, 12, 20, 26, 30, 33, 35, 57)
SUFFIX_BUCKETS = 3


def _sample_postings(length: int):
    span = length - COVER_PERIOD + 1                               # equal bytes left after the common shift
    covered = np.zeros(COVER_PERIOD, dtype=bool)
    covered[list(COVER)] = True

    def run(batches):
        for rows in blocks(batches):
            rows = [r for r in rows if len(r[2]) >= length]
            if not rows:
                continue
            block = Block(rows)
            sizes = np.diff(block.offsets)
            row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
            index = np.arange(len(row)) - block.offsets[row]
            at = np.flatnonzero(covered[index % COVER_PERIOD] & (index + span <= sizes[row]))
            index, row = index[at], row[at]
            yield {"key": Rolling(BYTE_VALUES[block.bytes]).windows(at, span), "doc": block.ids[row],
                   "place": (block.parts[row] << postings.PLACE_BITS) | index,
                   "index": np.ones(len(at), dtype=bool), "many": np.zeros(len(at), dtype=bool)}
    return run


def _suffix_postings(length: int, bucket: int, buckets: int):
    span = length - COVER_PERIOD + 1

    def run(batches):
        for batch in batches:
            found = batch.column("found").to_pylist()
            at_row = 0
            for rows in blocks([batch]):
                block = Block(rows)
                near = np.zeros(len(block.bytes) + 1, dtype=np.int32)
                for r, (_, part, raw) in enumerate(rows):
                    hits = postings.positions(found[at_row + r], part)
                    hits = hits[hits + span <= len(raw)]
                    base = block.offsets[r]
                    np.add.at(near, base + np.maximum(hits - (length - span), 0), 1)
                    np.add.at(near, base + hits + 1, -1)
                at_row += len(rows)
                starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                row = np.repeat(np.arange(len(rows)), np.diff(block.offsets))[starts]
                fits = starts + length <= block.offsets[row + 1]
                starts, row = starts[fits], row[fits]
                key = Rolling(BYTE_VALUES[block.bytes]).windows(starts, length)
                mine = key % U64(buckets) == bucket
                starts, row, key = starts[mine], row[mine], key[mine]
                yield {"key": key, "key2": (Rolling(BYTE_VALUES2[block.bytes], ODD2).windows(starts, length) >> np.uint32(16)).astype(np.uint16),
                       "doc": block.ids[row],
                       "place": (block.parts[row] << postings.PLACE_BITS) | (starts - block.offsets[row])}
    return run


def repeated_suffixes(docs: DataFrame, length: int = LENGTH, buckets: int = SUFFIX_BUCKETS) -> DataFrame:
    """(doc_id, found list): starts of strings of ``length`` bytes that also begin at an earlier (doc_id, part, start).

    Takes ``documents(...)`` rows; ids of null and texts under ``length`` bytes have none.
    """
    texts = docs.where("doc_id is not null and text is not null")
    near = materialize(postings.search(texts, _sample_postings(length),
                                       lambda post, last: postings.shared_anywhere(post, last, False)), "cover-hits")
    around = materialize(texts.join(near, "doc_id"), "cover-texts")
    discard(near)
    found = [materialize(postings.search(around, _suffix_postings(length, b, buckets), postings.earlier_place), f"suffixes-{b}")
             for b in range(buckets)]
    discard(around)
    return reduce(DataFrame.union, found).groupBy("doc_id").agg(F.collect_list("found").alias("found"))


CLEAN = ("doc_id bigint, part int, n_bytes bigint, n_removed bigint, kept binary, "
         "spans array<struct<start:bigint,bytes:bigint>>")


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, buckets: int = SUFFIX_BUCKETS) -> DataFrame:
    """Bytes of every text without those that an earlier string of ``length`` bytes covers.

    Returns doc_id, part, n_bytes, n_removed, kept (bytes, perhaps cut inside a character) and the removed runs. Null texts
    count as empty; rows that share an id are documents of their own, in the order of their texts.
    """
    docs = documents(docs)

    def run(batches):
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(),
                 pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))]
        names = ["doc_id", "part", "n_bytes", "n_removed", "kept", "spans"]

        def batch_of(rows):
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        out = []
        for batch in batches:
            for doc, part, text, found in zip(*(batch.column(n) for n in ("doc_id", "part", "text", "found"))):
                raw, part = (text.as_py() or "").encode(), part.as_py()
                lists = found.as_py() or []
                gone = np.zeros(len(raw) + 1, dtype=np.int32)
                for f in lists:
                    starts = postings.positions(f, part)
                    gone[starts] += 1                              # starts of one list differ
                    gone[starts + length] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes() if len(edges) else raw
                out.append((doc.as_py(), part, len(raw), len(raw) - len(kept), kept,
                            [{"start": int(a), "bytes": int(b - a)} for a, b in edges]))
                if len(out) == 256:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    return docs.join(repeated_suffixes(docs, length, buckets), "doc_id", "left").mapInArrow(run, CLEAN)


def suffix_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    return dedup_suffixes(docs, length).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                               F.sha2("kept", 256).alias("kept_sha256"))
