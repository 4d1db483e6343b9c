"""Exact search for repeated keys over all documents: packed postings, dealt out by key, answered by document.

A posting is (key, doc, place), where place is part << 40 | position. Tasks pack the postings of each key bucket into one
compressed blob, so the shuffle carries about ten bytes a posting. Before that, every chunk of a task combines what it can
decide alone: a key that repeats inside the chunk leaves it once, however often it occurs. So a key which holds a third
of all rows sends one posting per chunk, and no group grows with the number of its copies.

Answers go to buckets of documents and are gathered to one row per document: (doc_id, found): its sorted places, compressed.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netstate.llm.texts import U64, mixed

PLACE_BITS = 40
CHUNK = 1_500_000
BLOBS = "bucket int, blob binary"
FOUND = "doc_id bigint, found binary"


def bucket_bits(df: DataFrame) -> int:
    """Bits of the bucket number: at least twice as many buckets as shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(20, max(4, (2 * n - 1).bit_length()))


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns as one compressed Arrow message; doc and place as differences."""
    arrays = {}
    for name, x in columns.items():
        if name in ("doc", "place"):
            x = np.diff(x, prepend=np.int64(0))
        arrays[name] = pa.array(x)
    batch = pa.record_batch(arrays)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blobs) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {}
    for blob in blobs:
        table = pa.ipc.open_stream(blob.as_buffer()).read_all()
        for name in table.column_names:
            x = table.column(name).to_numpy()
            parts.setdefault(name, []).append(np.cumsum(x) if name in ("doc", "place") else x)
    return {name: np.concatenate(x) for name, x in parts.items()}


def scattered(buckets: np.ndarray, bits: int, columns: dict[str, np.ndarray], sign: int = 1) -> Iterator[tuple[int, bytes]]:
    """A blob for each bucket. Buckets of answers get negative numbers."""
    buckets = buckets.astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.diff(buckets[order], prepend=buckets[order[0]] + 1 if len(order) else 0))
    for a, b in zip(edges, [*edges[1:], len(order)]):
        take = order[a:b]
        bucket = int(buckets[take[0]])
        yield (bucket if sign > 0 else -1 - bucket), pack({name: x[take] for name, x in columns.items()})


def answers(doc: np.ndarray, place: np.ndarray, bits: int, turn: int) -> Iterator[tuple[int, bytes]]:
    """Answers by the upper half of the document bucket; ``turn`` spreads what one upper half gets over several groups.

    Every sender has a blob for each upper half only, and ``regroup`` deals out the rest: else there would be a blob for each
    pair of sender and document bucket, which grows with the square of the number of partitions.
    """
    if len(doc):
        upper, turns = bits // 2, 1 << (bits - bits // 2)
        group = (mixed(doc.astype(U64)) >> U64(64 - upper)) * U64(turns) + U64(turn % turns)
        yield from scattered(group, bits, {"doc": doc, "place": place}, -1)


def as_batches(rows: Iterator[tuple[int, bytes]], at_once: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes]] = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield _batch(held)
            held = []
    yield _batch(held)


def _batch(rows):
    return pa.record_batch({"bucket": pa.array([r[0] for r in rows], pa.int32()),
                            "blob": pa.array([r[1] for r in rows], pa.binary())})


class Groups:
    """Equal keys side by side: order, group number of each sorted entry and the smallest (doc, place) of each group."""

    def __init__(self, key: np.ndarray, doc: np.ndarray, place: np.ndarray, key2: np.ndarray | None = None):
        self.order = np.argsort(key)
        k = key[self.order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        if key2 is not None:
            k2 = key2[self.order]
            if np.any(~new[1:] & (k2[1:] != k2[:-1])):             # equal in the first key only
                self.order = np.lexsort((key2, key))
                k, k2 = key[self.order], key2[self.order]
                new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
        self.starts = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.doc, self.place = doc[self.order], place[self.order]
        self.first_doc = np.minimum.reduceat(self.doc, self.starts)
        of_first = self.doc == self.first_doc[self.group]
        self.of_first = of_first
        self.first_place = np.minimum.reduceat(np.where(of_first, self.place, np.iinfo(np.int64).max), self.starts)

    def any(self, flags: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(flags, self.starts)


#: A rule gets postings and says which are answers, and which of the others others must hear of.
Rule = Callable[[dict[str, np.ndarray], bool], tuple[np.ndarray, np.ndarray, np.ndarray]]


def shared_anywhere(post: dict[str, np.ndarray], last: bool, other_docs: bool):
    """Answers: postings whose key occurs elsewhere, in another document or (without ``other_docs``) at another place.

    ``index`` marks postings of the index side; a key without one is no answer. ``many``: keys that a chunk has answered.
    """
    g = Groups(post["key"], post["doc"], post["place"])
    many = g.any(post["many"][g.order])
    if other_docs:
        several = np.maximum.reduceat(g.doc, g.starts) != g.first_doc
    else:
        several = np.diff(g.starts, append=len(g.group)) > 1
    known = (several & g.any(post["index"][g.order])) | many if last else several
    hit = known[g.group]
    # of an answered key one posting goes on and is not answered again
    lead = np.zeros(len(hit), dtype=bool)
    lead[g.starts] = True
    return g.order[hit], g.order[~hit | lead], g.order[hit & lead]


def earlier_doc(post: dict[str, np.ndarray], last: bool):
    """Answers: postings whose key occurs in a document with a smaller id."""
    g = Groups(post["key"], post["doc"], post["place"], post["key2"])
    return g.order[~g.of_first], g.order[g.of_first], g.order[:0]


def earlier_place(post: dict[str, np.ndarray], last: bool):
    """Answers: postings whose key occurs at a smaller (doc, place)."""
    g = Groups(post["key"], post["doc"], post["place"], post["key2"])
    first = g.of_first & (g.place == g.first_place[g.group])
    return g.order[~first], g.order[first], g.order[:0]


def search(docs: DataFrame, postings_of: Callable, rule: Callable) -> DataFrame:
    """(doc_id, found) of documents with answers.

    ``postings_of(batches)`` yields dicts of arrays key, doc, place and whatever ``rule`` reads; docs may have any columns.
    A pass over the documents, one shuffle of packed postings, two of the answers.
    """
    bits = bucket_bits(docs)

    def probe(batches):
        def rows():
            held, size = [], 0
            for post in postings_of(batches):
                held.append(post)
                size += len(post["key"])
                if size >= CHUNK:
                    yield from decide(held)
                    held, size = [], 0
            if size:
                yield from decide(held)

        def decide(held):
            post = {name: np.concatenate([x[name] for x in held]) for name in held[0]}
            hits, on, answered = rule(post, False)
            hits = np.sort(hits)                                   # back to the order of documents
            yield from answers(post["doc"][hits], post["place"][hits], bits, int(post["key"][0] & U64(0xFFFF)))
            if "many" in post:
                post["many"] = np.zeros(len(post["key"]), dtype=bool)
                post["many"][answered] = True
            on = np.sort(on)
            post = {name: x[on] for name, x in post.items()}
            yield from scattered(post["key"] >> U64(64 - bits), bits, post)
        return as_batches(rows())

    def judge(table: pa.Table) -> pa.Table:
        bucket, blobs = table.column("bucket")[0].as_py(), table.column("blob")
        if bucket < 0:                                            # answers of chunks go on as they are
            return table
        post = unpack(blobs)
        hits, _, _ = rule(post, True)
        if "many" in post:
            hits = hits[~post["many"][hits]]
        doc, place = post["doc"][hits], post["place"][hits]
        order = np.argsort(doc)
        return pa.Table.from_batches(list(as_batches(answers(doc[order], place[order], bits, bucket))))

    def regroup(table: pa.Table) -> pa.Table:
        post = unpack(table.column("blob"))
        order = np.argsort(post["doc"])
        doc, place = post["doc"][order], post["place"][order]
        return pa.Table.from_batches(list(as_batches(scattered(mixed(doc.astype(U64)) >> U64(64 - bits), bits,
                                                               {"doc": doc, "place": place}))))

    def gather(table: pa.Table) -> pa.Table:
        post = unpack(table.column("blob"))
        order = np.argsort(post["doc"])
        doc, place = post["doc"][order], post["place"][order]
        edges = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
        found = [squeezed(np.unique(place[a:b])) for a, b in zip(edges, [*edges[1:], len(doc)])]
        return pa.table({"doc_id": pa.array(doc[edges], pa.int64()), "found": pa.array(found, pa.binary())})

    packed = docs.mapInArrow(probe, BLOBS)
    return (packed.groupBy("bucket").applyInArrow(judge, BLOBS)
            .groupBy("bucket").applyInArrow(regroup, BLOBS)
            .groupBy("bucket").applyInArrow(gather, FOUND))


def squeezed(places: np.ndarray) -> bytes:
    raw = np.diff(places, prepend=np.int64(0)).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def positions(found: bytes | None, part: int) -> np.ndarray:
    """Positions of one part among the places of a document."""
    if not found:
        return np.zeros(0, dtype=np.int64)
    raw = pa.decompress(found[8:], int.from_bytes(found[:8], "little"), codec="zstd", asbytes=True)
    places = np.cumsum(np.frombuffer(raw, dtype=np.int64))
    return places[places >> PLACE_BITS == part] & ((1 << PLACE_BITS) - 1)
