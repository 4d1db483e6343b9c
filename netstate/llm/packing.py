"""Packing of documents into sequences of a fixed number of tokens by a linear program over configurations.

A configuration says how many pieces of each length share one sequence. The program covers the length histogram with as few
configurations as it can. It knows nothing of single documents: the histogram has at most ``capacity`` entries at any size of
the corpus, so it is solved on the driver (:func:`configurations`), and pieces are dealt to places by their rank among the
pieces of their length, in Spark.

* Multiplicative weights: each length has a price, falling exponentially with the share of its pieces that is covered. Dynamic
  programming for a knapsack finds the configuration of the highest total price; it enters until a length in it is covered.
  Starting prices grow a little faster than the lengths, so short pieces, which fit anywhere, are left for gaps.
* Rounding: whole multiples of configurations, fullest first, as far as there are pieces.
* What is left goes, longest first, into the smallest gap that holds it (best fit, on the histogram).
"""
from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netstate.llm.bpe import SPLIT, _vocabulary, printable
from netstate.llm.texts import documents
from netstate.session import materialize

#: Learning rate and start of the weights, and steps of the program: the defaults were measured on piece histograms.
RATE, TILT, STEPS = 0.5, 1.0, 900
SEGMENT = 1 << 20

Config = tuple[tuple[int, int], ...]
"""((length, pieces), ...), longest first."""


# --- the linear program, on the histogram ------------------------------------------------------------------------------

def knapsack(price: np.ndarray, limit: np.ndarray, capacity: int) -> dict[int, int]:
    """{length: pieces} of the highest total price within ``capacity`` and at most ``limit`` pieces of a length."""
    best = np.zeros(capacity + 1)
    rows: list[tuple[int, int, np.ndarray]] = []
    for length in np.flatnonzero(limit)[::-1].tolist():
        left, lot = min(int(limit[length]), capacity // length), 1
        while left:                                                 # lots of 1, 2, 4, ... pieces reach any number
            lot = min(lot, left)
            left -= lot
            with_lot = best[:capacity + 1 - lot * length] + lot * price[length]
            better = with_lot > best[lot * length:]
            best = best.copy()
            best[lot * length:][better] = with_lot[better]
            rows.append((length, lot, better))
            lot *= 2
    room, out = int(best.argmax()), defaultdict(int)
    for length, lot, better in reversed(rows):
        if room >= lot * length and better[room - lot * length]:
            out[length] += lot
            room -= lot * length
    return dict(out)


def fractional(need: np.ndarray, capacity: int, steps: int = STEPS) -> dict[Config, float]:
    """Multiples of configurations that cover ``need`` (pieces by length), by multiplicative weights."""
    lengths = np.arange(capacity + 1)
    start = lengths * (1 + TILT * lengths / capacity)
    there = need > 0
    covered = np.zeros(capacity + 1)
    multiples: dict[Config, float] = defaultdict(float)
    for _ in range(steps):
        least = covered[there].min()
        if least >= 1 - 1e-9:
            break
        price = start * np.exp(-RATE * (covered - least))
        chosen = knapsack(price, np.where(there & (covered < 1 - 1e-9), need, 0), capacity)
        amount = min((1 - covered[n]) * need[n] / k for n, k in chosen.items())
        amount = max(amount, min(need[n] / k for n, k in chosen.items()) / 50)       # steps never get too small to end
        multiples[tuple(sorted(chosen.items(), reverse=True))] += amount
        for n, k in chosen.items():
            covered[n] += amount * k / need[n]
    return multiples


def rounded(multiples: dict[Config, float], need: np.ndarray) -> tuple[list[tuple[int, Config]], np.ndarray]:
    """([(sequences, configuration)], pieces by length that are left)."""
    rest, out = need.copy(), []
    for config, amount in sorted(multiples.items(), key=lambda x: (-sum(n * k for n, k in x[0]), x[0])):
        whole = min([int(amount + 1e-9), *(int(rest[n]) // k for n, k in config)])
        if whole:
            out.append((whole, config))
            for n, k in config:
                rest[n] -= whole * k
    return out, rest


def best_fit(rest: np.ndarray, filled: list[tuple[int, Config]], capacity: int) -> list[tuple[int, Config]]:
    """Puts the pieces ``rest``, longest first, into the smallest gaps of ``filled`` that hold them, or new sequences."""
    gaps: dict[int, list[tuple[int, Config]]] = defaultdict(list)
    for copies, config in filled:
        gaps[capacity - sum(n * k for n, k in config)].append((copies, config))
    for length in np.flatnonzero(rest)[::-1].tolist():
        left = int(rest[length])
        while left:
            gap = min((g for g in gaps if g >= length and gaps[g]), default=None)
            copies, config = gaps[gap].pop() if gap is not None else (left, ())
            gap = capacity if gap is None else gap
            each = min(gap // length, left)
            used = min(copies, left // each)
            if copies > used and config:
                gaps[gap].append((copies - used, config))
            gaps[gap - each * length].append((used, (*config, (length, each))))
            left -= used * each
    return [x for group in gaps.values() for x in group]


def configurations(need: np.ndarray, capacity: int, steps: int = STEPS) -> list[tuple[int, Config]]:
    """[(sequences, configuration)] that hold exactly ``need[n]`` pieces of each length n up to ``capacity``.

    Rounding can lose on very small histograms what the program gained; then plain best fit of all pieces is returned.
    """
    need = np.asarray(need, dtype=np.int64)
    if not need.any():
        return []
    alone = need.copy()
    alone[:capacity] = 0                                            # full pieces fill a sequence each
    shared = need - alone
    whole = [(int(need[capacity]), ((capacity, 1),))] if need[capacity] else []
    plain = best_fit(shared, [], capacity)
    filled, rest = rounded(fractional(shared, capacity, steps), shared) if shared.any() else ([], shared)
    planned = best_fit(rest, filled, capacity)
    return whole + min(planned, plain, key=lambda x: sum(copies for copies, _ in x))


# --- pieces of documents ----------------------------------------------------------------------------------------------

#: Characters whose classes (letter, number, blank) no version of Unicode has changed; texts of others take the plain way.
SETTLED = "\x00-\u024f\u0400-\u0481\u2010-\u2027\u20ac\u4e00-\u9fa5"


class Tokens:
    """Ids of texts as the tokenizers library gives them for a byte-level vocabulary.

    Where that is provably the same, ids come from the rank encoder of tiktoken, which is several times faster: merges in the
    order of their ids, the published split pattern, only ``SETTLED`` characters and no special token in the text.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.plain = Tokenizer.from_str(vocabulary)
        self.plain.no_truncation()
        self.plain.no_padding()
        spec = json.loads(vocabulary)
        special = [t["content"] for t in spec["added_tokens"]]
        self.odd = re.compile("|".join([f"[^{SETTLED}]", *map(re.escape, special)])).search
        self.cut = re.compile(r" (?=\S)")
        self.ranked = self._ranked(spec, special)

    @staticmethod
    def _ranked(spec: dict, special: list[str]):
        ids, split = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
        made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) != ("ByteLevel", True, False) \
                or spec.get("normalizer") or made != sorted(set(made)) or len(made) + 256 != len(set(ids) - set(special)):
            return None
        import tiktoken
        byte_of = printable()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in ids.items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _segments(self, text: str) -> Iterator[str]:
        """Parts of at least ``SEGMENT`` characters, cut before a blank and a visible character: no token crosses that."""
        begin = 0
        while len(text) - begin > SEGMENT and (found := self.cut.search(text, begin + SEGMENT)):
            yield text[begin:found.start()]
            begin = found.start()
        yield text[begin:]

    def ids(self, text: str) -> np.ndarray:
        if self.ranked and not self.odd(text):
            try:
                return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            except ValueError:                                      # its pattern gives up on very long blanks
                pass
        parts = [self.plain.encode(s, add_special_tokens=False).ids for s in self._segments(text)]
        return np.concatenate([np.array(p, dtype="<u4") for p in parts])


@lru_cache(maxsize=1)
def _tokens(vocabulary: str) -> Tokens:
    """One for each worker process."""
    return Tokens(vocabulary)


PIECES = "doc_id bigint, part int, piece int, start bigint, length int, ids_crc32 bigint, chunk int, nth int"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int | None = 2, with_ids: bool = False) -> DataFrame:
    """Token pieces of all documents: doc_id, part, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is the ids of its whole text (null: none) and then ``end``. Longer ones are cut into pieces of ``capacity``; the
    first piece takes what is over. ``part`` tells rows with the same doc_id apart. (chunk, length, nth) counts the pieces of
    a length through each task. Write the table before it is used twice: chunks are tasks.
    """
    held = docs.sparkSession.sparkContext.broadcast(_vocabulary(docs, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, chunk, seen = _tokens(held.value), TaskContext.get().partitionId(), defaultdict(int)
        tail = np.array([] if end is None else [end], dtype="<u4")
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows, ids_of = [], []
                for doc, number, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "part", "text"))):
                    ids = np.concatenate([tokens.ids(text or ""), tail])
                    edge = len(ids) % capacity
                    cuts = [0, *range(edge, len(ids) + 1, capacity)] if edge else [*range(0, len(ids) + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc, number, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), chunk, seen[b - a]))
                        seen[b - a] += 1
                        if with_ids:
                            ids_of.append(ids[a:b].astype(np.int32))
                columns = list(zip(*rows)) or [[]] * 8
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(),
                                                                   pa.int64(), pa.int32(), pa.int32()))]
                names = PIECES.replace(",", "").split()[::2]
                if with_ids:
                    arrays.append(pa.array(ids_of, pa.list_(pa.int32())))
                    names = [*names, "ids"]
                yield pa.record_batch(arrays, names=names)

    rows = documents(docs).select("doc_id", "part", "text")
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


# --- places -----------------------------------------------------------------------------------------------------------

def places(plan: list[tuple[int, Config]], capacity: int) -> dict[str, np.ndarray]:
    """A row for each length in each configuration, by length: ranks from ``rank`` on sit ``each`` to a sequence, the first one at
    ``sequence`` and ``offset``. ``at`` holds where the rows of a length begin."""
    rows, sequence = [], 0
    for copies, config in plan:
        offset = 0
        for length, each in config:
            rows.append((length, sequence, offset, each, copies * each))
            offset += length * each
        sequence += copies
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    length, first, offset, each, ranks = columns
    before = np.cumsum(ranks) - ranks
    at = np.searchsorted(length, np.arange(capacity + 2))
    rank = before - before[np.minimum(at[length], len(before) - 1)] if len(before) else before
    return {"at": at, "rank": rank, "sequence": first, "offset": offset, "each": each}


def pack(table: DataFrame, capacity: int = 1024, steps: int = STEPS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of a written table of :func:`pieces`; other columns stay.

    Ranks among the pieces of a length are prefix sums of counts by task, so a length that half of all pieces have is never one
    group. The configurations that are broadcast have some thousand rows at most: ``steps`` and two for each length.
    """
    sc = table.sparkSession.sparkContext
    counts = materialize(table.groupBy("chunk", "length").agg((F.max("nth") + 1).cast("long").alias("n")), "piece-counts")
    need = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():            # at most ``capacity`` rows
        need[r["length"]] = r["n"]
    held = sc.broadcast(places(configurations(need, capacity, steps), capacity))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = table.join(counts, ["chunk", "length"]).withColumn("rank", F.col("_before") + F.col("nth")).drop("_before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = held.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            row, order = np.empty(len(rank), dtype=np.int64), np.argsort(length, kind="stable")
            edges = np.searchsorted(length[order], np.arange(capacity + 2))
            for n in np.unique(length).tolist():
                mine, at = order[edges[n]:edges[n + 1]], spots["at"]
                row[mine] = at[n] + np.searchsorted(spots["rank"][at[n]:at[n + 1]], rank[mine], "right") - 1
            nth, each = rank - spots["rank"][row], spots["each"][row]
            sequence, offset = spots["sequence"][row] + nth // each, spots["offset"][row] + nth % each * length
            yield pa.record_batch([*batch.columns, pa.array(sequence), pa.array(offset)],
                                  names=[*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint").drop("chunk", "nth", "rank")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and the starts of its pieces, of a packed table with ids; a group has at most ``capacity`` ids."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("_rows")).select(
        "sequence_id", F.flatten("_rows.ids").alias("ids"), F.col("_rows.offset").alias("offsets"))


def packing_digest(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    Null and empty texts are one piece, ``end`` alone. Rows with the same or no doc_id are documents of their own. Which of two
    pieces of one length comes first is open; no result depends on it but their places. An empty table has no pieces. Columns
    other than doc_id and text are left behind.
    """
    table = materialize(pieces(docs, vocabulary, capacity, end), "pieces")
    return pack(table, capacity).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                                        "sequence_id", "offset")
