"""Substring dedup on words: fixed-block anchors.

Any ``window`` words contain a whole reference block if blocks have (window + 1) / 2 words and begin at every multiple of
that length. So non-overlapping blocks form the index and every rolling window of that length probes it. Around hits
the match is extended: all windows that contain a hit are compared by 96-bit hashes, and runs of confirmed windows are the
maximal exact repeats. Only words around hits take part in the second search.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.llm import postings
from netstate.llm.texts import ODD2, U64, Block, Rolling, blocks, documents, mixed
from netstate.session import discard, materialize

WINDOW = 13


def _block_postings(length: int):
    def run(batches):
        for rows in blocks(batches):
            block = Block(rows)
            words = block.words()
            at = words.windows_starting(length)
            row = words.row[at]
            yield {"key": Rolling(mixed(words.hash), ODD2).windows(at, length), "doc": block.ids[row],
                   "place": (block.parts[row] << postings.PLACE_BITS) | words.index[at],
                   "index": words.index[at] % length == 0, "many": np.zeros(len(at), dtype=bool)}
    return run


def _window_postings(window: int, length: int):
    def run(batches):
        for batch in batches:
            found = batch.column("found").to_pylist()
            at_row = 0
            for rows in blocks([batch]):
                block = Block(rows)
                words = block.words()
                near = np.zeros(len(words.row) + 1, dtype=np.int64)
                for r, (_, part, _) in enumerate(rows):
                    hits = postings.positions(found[at_row + r], part)
                    hits = hits[hits + length <= words.count[r]]
                    base = words.bounds[r]                        # windows that hold the hit begin up to so many words before
                    np.add.at(near, base + np.maximum(hits - (window - length), 0), 1)
                    np.add.at(near, base + hits + 1, -1)
                at_row += len(rows)
                starts = words.windows_starting(window)
                starts = starts[np.cumsum(near)[starts] > 0]
                row = words.row[starts]
                yield {"key": Rolling(mixed(words.hash), ODD2).windows(starts, window),
                       "key2": Rolling((words.hash >> U64(32)).astype(np.uint32)).windows(starts, window),
                       "doc": block.ids[row], "place": (block.parts[row] << postings.PLACE_BITS) | words.index[starts]}
    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, found): starts of windows of ``window`` words that also occur in a document with a smaller doc_id.

    Takes ``documents(...)`` rows. Null and empty texts and ids of null have no windows. Rows of equal ids are documents of
    their own, neither earlier than the other.
    """
    length = (window + 1) // 2
    texts = docs.where("doc_id is not null and text is not null")
    hits = materialize(postings.search(texts, _block_postings(length),
                                       lambda post, last: postings.shared_anywhere(post, last, True)), "anchor-hits")
    around = texts.join(hits, "doc_id")
    out = materialize(postings.search(around, _window_postings(window, length), postings.earlier_doc), "repeats")
    discard(hits)
    return out


KEPT = "doc_id bigint, part int, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,words:bigint>>"


def _kept(raw: bytes, found: bytes | None, part: int, window: int):
    words = raw.split()                                            # splits at blank and 0x09-0x0D
    starts = postings.positions(found, part)
    if not len(starts):
        return words, words, np.zeros((0, 2), dtype=np.int64)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    gone = np.cumsum(cover[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    return words, [w for w, g in zip(words, gone.tolist()) if not g], edges.reshape(-1, 2)


def _rows(batches):
    for batch in batches:
        cols = [batch.column(n) for n in ("doc_id", "part", "text", "found")]
        for doc, part, text, found in zip(*cols):
            yield doc.as_py(), part.as_py(), (text.as_py() or "").encode(), found.as_py()


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Text of every document without words that a window repeated from an earlier document covers.

    Returns doc_id, part, n_words, n_removed, kept (words joined by a blank) and the removed spans. Null texts count as empty.
    """
    docs = documents(docs)

    def run(batches):
        out = []
        for doc, part, raw, found in _rows(batches):
            words, kept, spans = _kept(raw, found, part, window)
            out.append((doc, part, len(words), len(words) - len(kept), b" ".join(kept).decode(),
                        [{"start": int(a), "words": int(b - a)} for a, b in spans]))
            if len(out) == 256:
                yield _kept_batch(out)
                out = []
        yield _kept_batch(out)

    return docs.join(repeated_windows(docs, window), "doc_id", "left").mapInArrow(run, KEPT)


def _kept_batch(rows):
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(),
             pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))]
    names = ["doc_id", "part", "n_words", "n_removed", "kept", "spans"]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def substring_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept text."""
    return dedup_substrings(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
