"""Near-duplicate documents by SetSketch.

A document is its set of distinct word shingles. Every shingle is the seed of a Poisson process of points, each dealt to
one of ``REGISTERS`` registers; a register keeps the smallest point of all shingles, truncated to a power of the base. So
registers of a union are the larger ones of the two (mergeable), equal registers are as likely as sets are alike
(locality-sensitive), and the counts of larger, smaller and equal registers give the Jaccard similarity by maximum likelihood.

1. Documents with equal sets form a class; only its smallest id goes on.
2. Bands of registers bring candidates together: every member of a band's bucket is compared with the one there that shares
   most buckets with others, which in a family of edited copies is the text that they come from.
3. The joint estimate drops what is far below the threshold; the rest is confirmed on the full sets; components follow.
4. Buckets that still hold several components: members outside the largest one are compared with the members of others that
   have enough shingles in common with anybody: shingles that no other member has are in no intersection, which bounds every
   similarity of a member from above. How much of a member is in the set of its bucket's centre is counted, one pair a member,
   and bounds a pair more tightly: edited copies of a text that share no edits are sorted out without being compared. So no pair of different components that shares enough buckets and can reach the
   threshold is left out, a bucket of thousands of copies costs one row a copy, and edited copies that are like nothing else
   cost nothing.

How many buckets a pair must share follows from the binomial tail of a pair at the threshold, which is missed with a probability
of at most ``MISS`` (from 80 % on; far below, more pairs share no bucket at all). How far below the threshold its estimate may
lie is the same tail for equal registers, less 0.02; for the likelihood estimate that is taken over, not proven.
"""
from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.llm.graph import components
from netstate.llm.texts import ODD, ODD2, U64, Block, Rolling, blocks, documents, mixed
from netstate.session import discard, materialize

SHINGLE = 5
BANDS, ROWS = 40, 5
REGISTERS, BASE = BANDS * ROWS, 1.02
#: Points above this many mean gaps of a register are left out: a register misses its minimum with probability exp(-REACH).
REACH = 6.0 + np.log(REGISTERS)
#: Chance of a test to miss a pair at the threshold.
MISS = 5e-7
SKETCHES = ("doc_id bigint, part int, n_shingles bigint, set1 bigint, set2 bigint, sketch binary, bands array<bigint>")


def shingle_sets(rows: list[tuple[int, int, bytes]], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a text with fewer words is one shingle, without words none."""
    block = Block(rows)
    words = block.words(lower=True)
    roll = Rolling(mixed(words.hash), ODD2)
    starts = words.windows_starting(shingle)
    hashes, edges = roll.windows(starts, shingle), np.searchsorted(starts, words.bounds)
    out = []
    for r, n in enumerate(words.count.tolist()):
        if 0 < n < shingle:
            out.append(roll.windows(np.array([words.bounds[r]]), n))
        else:
            out.append(np.unique(hashes[edges[r]:edges[r + 1]]))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (rows x REGISTERS, uint16) of sets of 64-bit values, all sets of a block at once."""
    sizes = np.array([len(s) for s in sets])
    least = np.full((len(sets), REGISTERS), np.inf)
    seed, row, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), np.zeros(sizes.sum())
    reach = np.repeat(REACH / np.maximum(sizes, 1), sizes)
    step = np.zeros(1, dtype=U64)
    while len(seed):
        step = step + U64(ODD)
        draw = mixed(seed + step)
        at = at - np.log(((draw >> U64(16)).astype(np.float64) + 0.5) / (1 << 48)) / REGISTERS
        live = at <= reach
        seed, row, at, reach, draw = seed[live], row[live], at[live], reach[live], draw[live]
        register = ((draw & U64(0xFFFF)) * U64(REGISTERS) >> U64(16)).astype(np.int64)
        np.minimum.at(least, (row, register), at)
    value = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(value, 0, 65535).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of a union."""
    return np.maximum(a, b)


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches, by maximum likelihood over a grid, given the sizes of the sets."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)

    def share(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = share(u - (1 - u) * grid), share(1 - u - u * grid)
    tiny = 1e-12
    fit = (more * np.log(p + tiny) + less * np.log(q + tiny)
           + (a.shape[1] - more - less) * np.log(np.maximum(1 - p - q, tiny)))
    return grid[np.arange(len(fit)), fit.argmax(axis=1)]


def least_hits(n: int, p: float, miss: float = MISS) -> int:
    """The largest k such that fewer than k hits in ``n`` draws of probability ``p`` have at most the probability ``miss``."""
    below, k = 0.0, 0
    while k < n:
        below += comb(n, k) * p ** k * (1 - p) ** (n - k)
        if below > miss:
            break
        k += 1
    return k


def least_bands(percent: int) -> int:
    """Buckets that a pair of ``percent`` similarity shares at least; one at any threshold, since others never meet."""
    return max(1, least_hits(BANDS, (percent / 100) ** ROWS))


def least_estimate(percent: int) -> float:
    """The estimate of a pair of ``percent`` similarity, at least; 0.02 are for the grid and the truncation."""
    return least_hits(REGISTERS, percent / 100) / REGISTERS - 0.02


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64), pa.int64())


def sketched(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Set size, identity of the set in 128 bits, registers and band keys of every ``documents(...)`` row."""
    def run(batches):
        for rows in blocks(batches, 1 << 20):
            sets = shingle_sets(rows, shingle)
            regs = sketches(sets)
            bands = np.zeros((len(rows), BANDS), dtype=U64) + np.arange(1, BANDS + 1, dtype=U64) * U64(ODD)
            for k in range(ROWS):
                bands = mixed(bands ^ regs[:, k::ROWS].astype(U64)) + U64(ODD2)
            filled = [len(s) > 0 for s in sets]
            yield pa.record_batch({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([r[1] for r in rows], pa.int32()),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set1": _signed(np.array([mixed(s).sum(dtype=U64) for s in sets])),
                "set2": _signed(np.array([np.bitwise_xor.reduce(mixed(s * U64(ODD2))) if len(s) else 0 for s in sets], dtype=U64)),
                "sketch": pa.array([r.tobytes() if f else None for r, f in zip(regs, filled)], pa.binary()),
                "bands": pa.array([b if f else None for b, f in zip(bands.astype(np.int64), filled)], pa.list_(pa.int64()))})
    return docs.select("doc_id", "part", "text").mapInArrow(run, SKETCHES)


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose estimate isn't far below it."""
    least = least_estimate(percent)

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
                    for c in ("sketch_a", "sketch_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            ok = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
            ok[ok] = estimated(a[ok], b[ok], n_a[ok], n_b[ok]) >= least
            yield batch.select(["a", "b"]).filter(pa.array(ok))
    side = reps.select("rep", "sketch", "n_shingles")
    both = (pairs.join(side.toDF("a", "sketch_a", "n_a"), "a").join(side.toDF("b", "sketch_b", "n_b"), "b")
            .select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b"))
    return both.mapInArrow(run, "a bigint, b bigint")


def _intersections(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(a, b, n_a, n_b, same) of pairs of class representatives: sizes of their full sets and of the intersection."""
    def sets_of(batches):
        for rows in blocks(batches):
            yield pa.record_batch({"doc_id": pa.array([r[0] for r in rows], pa.int64()),
                                   "shingles": pa.array([s.tobytes() for s in shingle_sets(rows, shingle)], pa.binary())})

    def meet(batches):
        for batch in batches:
            counts = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=U64) for v in (x, y))
                counts.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            found = [pa.array(c, pa.int64()) for c in zip(*counts)] or [pa.array([], pa.int64())] * 3
            yield pa.record_batch([*batch.select(["a", "b"]).columns, *found], names=["a", "b", "n_a", "n_b", "same"])

    needed = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct().join(reps.select("rep", "part"), "rep")
    sets = materialize(docs.select("doc_id", "part", "text").join(needed.toDF("doc_id", "part"), ["doc_id", "part"])
                       .mapInArrow(sets_of, "doc_id bigint, shingles binary"), "shingle-sets")
    both = (pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y"))
    out = materialize(both.mapInArrow(meet, "a bigint, b bigint, n_a bigint, n_b bigint, same bigint"), "near-links")
    discard(sets)
    return out


def _confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs (a, b) of class representatives with 100 x intersection >= percent x union of their full sets."""
    found = _intersections(pairs, docs, reps, shingle)
    return found.where(f"100 * same >= {percent} * (n_a + n_b - same)").select("a", "b")


def _private(members: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(rep, private): how many shingles of a member no other of ``members`` has; those without any are left out."""
    def run(batches):
        for rows in blocks(batches):
            sets = shingle_sets(rows, shingle)
            yield pa.record_batch({"rep": pa.array(np.repeat([r[0] for r in rows], [len(s) for s in sets]), pa.int64()),
                                   "shingle": _signed(np.concatenate(sets))})

    needed = members.select("rep").distinct().join(reps.select("rep", "part"), "rep")
    each = docs.select("doc_id", "part", "text").join(needed.toDF("doc_id", "part"), ["doc_id", "part"]).mapInArrow(
        run, "rep bigint, shingle bigint")
    alone = each.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("rep").alias("rep")).where("holders = 1")
    return alone.groupBy("rep").agg(F.count("*").alias("private"))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, part, n_shingles and component_id of every row: the smallest doc_id that links of ``percent`` similarity reach.

    Null or empty texts have no shingles and are linked with nothing. Rows of one doc_id count as one document in links; rows
    without an id are alone (component_id null). Repeated rows get equal results.
    """
    docs = documents(docs)
    drawn = materialize(sketched(docs, shingle), "sketches")
    classes = materialize(drawn.where("n_shingles > 0 and doc_id is not null").groupBy("set1", "set2").agg(
        F.min(F.struct("doc_id", "part", "n_shingles", "sketch", "bands")).alias("r")).select(
        "set1", "set2", F.col("r.doc_id").alias("rep"), "r.part", "r.n_shingles", "r.sketch", "r.bands"), "classes")
    banded = classes.select(F.explode("bands").alias("band"), "rep")
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    several = materialize(banded.join(shared, "band"), "shared-bands")
    degree = several.groupBy("rep").agg(F.sum("size").alias("degree"))
    ranked = several.select("band", "rep").join(degree, "rep")
    centre = ranked.groupBy("band").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("a"))
    members = materialize(several.select("band", "rep").join(centre, "band"), "band-members")
    discard(several)
    tested = materialize(members.where("rep <> a").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct(), "tested")
    own = drawn.where("n_shingles > 0 and doc_id is not null").join(classes.select("set1", "set2", "rep"), ["set1", "set2"])
    same = own.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirmed(materialize(_plausible(tested, classes, percent), "plausible"), docs, classes, percent, shingle)
    root = materialize(components(links), "roots")
    placed = members.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "band", "rep", "a", F.coalesce("root", "rep").alias("root"))
    count = placed.groupBy("band", "root").count().groupBy("band").agg(
        F.max_by("root", F.struct("count", "root")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    several = materialize(placed.join(count.drop("kinds"), "band"), "mixed-bands")
    private = _private(several, docs, classes, shingle)
    shared = classes.select("rep", F.col("n_shingles").alias("n")).join(private, "rep", "left").select(
        "rep", "n", (F.col("n") - F.coalesce("private", F.lit(0))).alias("common"))
    open_bands = materialize(several.join(shared.where(f"100 * common >= {percent} * n"), "rep"), "open-bands")
    # Of a pair's intersection, what lies in the set of the bucket's centre is at most what either has of it, and the rest
    # at most what either shares with others outside it. (The centre is a member, so what it holds is shared.)
    meets = _intersections(open_bands.where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), docs, classes, shingle)
    inner = open_bands.join(meets.select("a", F.col("b").alias("rep"), "same"), ["a", "rep"], "left").withColumn(
        "inner", F.coalesce("same", "n")).withColumn("outer", F.col("common") - F.col("inner"))
    # A pair comes out once, in the first bucket that it shares and in one order: all of its buckets are among these, since
    # a bucket of two components is open to both.
    side = inner.join(classes.select("rep", "bands"), "rep")
    both_in = F.array_intersect("bands_x", "bands_y")
    most = "(least(inner_x, inner_y) + least(outer_x, outer_y))"
    held = ("rep", "root", "n", "inner", "outer", "bands")
    x = side.where("root <> top").select("band", "top", *[F.col(c).alias(f"{c}_x") for c in held])
    y = side.select("band", *[F.col(c).alias(f"{c}_y") for c in held])
    cross = (x.join(y, "band")
             .where("root_x <> root_y and (root_y = top or rep_x < rep_y)")
             .where(f"100 * {most} >= {percent} * (n_x + n_y - {most})")
             .where((F.array_min(both_in) == F.col("band")) & (F.size(both_in) >= least_bands(percent)))
             .select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
             .join(tested, ["a", "b"], "left_anti"))
    more = _confirmed(materialize(_plausible(cross, classes, percent), "plausible"), docs, classes, percent, shingle)
    found = components(links.union(more).union(same))
    return drawn.select("doc_id", "part", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "part", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def near_digest(docs: DataFrame, percent: int = 85) -> DataFrame:
    return near_duplicates(docs, percent).select("doc_id", "n_shingles", "component_id",
                                                 (F.col("doc_id") == F.col("component_id")).alias("kept"))
