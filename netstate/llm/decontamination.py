"""Benchmark decontamination by spaced seeds. DataFrame functions only.

A mask names the positions of a span of tokens that are hashed; the others are ignored, so a substituted word there does not
prevent a hit. Each mask is hashed at each position of documents and of benchmark items and the hashes are joined. Items shorter
than a stretch are cut into runs instead, one more than substitutions are allowed, so one run is left whole. Around a
hit, item and document are laid side by side: they overlap if a stretch of ``STRETCH`` tokens (or the whole item, if shorter) has
at least 80 % equal tokens.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.llm.texts import documents, packed, unpacked

#: Offsets of the hashed tokens. The first leaves out every fifth position, the third every third. Any two substitutions in a
#: stretch of 13 tokens leave a place for one of the four (tested).
MASKS = ((0, 1, 2, 3, 5, 6), (0, 2, 3, 5, 6, 8), (0, 1, 3, 4, 6, 7), (0, 1, 2, 3, 7, 8))
STRETCH, PERCENT = 13, 80
#: Benchmarks of up to so many tokens are sent to every task; larger ones are joined by shuffling.
BROADCAST_TOKENS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits of the lower-cased text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, words: str, at: str, masks) -> DataFrame:
    """One row for each mask at each position at which its first token exists; a mask that runs over the end has none."""
    hashed = F.array(*[F.when(F.col(at) + mask[-1] < F.size(words), F.xxhash64(F.lit(k), *[F.get(words, F.col(at) + o) for o in mask]))
                       for k, mask in enumerate(masks)])
    return rows.select("*", F.explode(hashed).alias("seed")).where("seed is not null")


def runs(size: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(first token, tokens) of the runs into which an item of ``size`` tokens is cut: one more than it may have substitutions."""
    n = size - -(-size * percent // 100) + 1
    return [(size * i // n, size * (i + 1) // n - size * i // n) for i in range(n)]


def overlaps(docs: DataFrame, benchmark: DataFrame, masks=MASKS, stretch: int = STRETCH, percent: int = PERCENT) -> DataFrame:
    """Distinct (doc_id, part, item_id) of ``documents(...)`` rows that overlap an item. Null texts overlap nothing."""
    items = benchmark.where("text is not null").select("item_id", tokens(F.col("text")).alias("item"))
    size = F.size("item")
    total, short = items.agg(F.sum(size), F.collect_set(F.when((size > 0) & (size < stretch), size))).first()   # below stretch
    cut = {n: runs(n, percent) for n in sorted(short)}
    lengths = sorted({length for found in cut.values() for _, length in found})
    probed = [*masks, *[tuple(range(n)) for n in lengths]]

    def places(array):
        return F.explode(F.sequence(F.lit(0), F.greatest(F.size(array) - 1, F.lit(0))))
    index = (_seeds(items.where(size >= stretch).select("item_id", "item", places("item").alias("item_at")), "item", "item_at", masks)
             .select("seed", "item_id", "item", "item_at"))
    for n, found in cut.items():
        seeds = F.array(*[F.struct(F.xxhash64(F.lit(len(masks) + lengths.index(length)), *[F.get("item", F.lit(at + o)) for o in range(length)])
                                   .alias("seed"), F.lit(at).alias("item_at")) for at, length in found])
        index = index.union(items.where(size == n).select("item_id", "item", F.explode(seeds).alias("s"))
                            .select("s.seed", "item_id", "item", "s.item_at"))
    if (total or 0) <= BROADCAST_TOKENS:
        index = F.broadcast(index)
    words = docs.where("text is not null").select("doc_id", "part", tokens(F.col("text")).alias("words"))
    probes = _seeds(words.select("doc_id", "part", "words", places("words").alias("at")), "words", "at", probed)
    # A hit takes the document's tokens beside the item along; hits of the same shift are one. Positions, seeds and join run
    # in one generated loop that never copies the tokens of a document, and the comparison comes after the aggregation.
    shift = F.col("at") - F.col("item_at")
    beside = F.slice("words", F.greatest(shift, F.lit(0)) + 1, F.size("item") + F.least(shift, F.lit(0)))
    hits = (probes.join(index, "seed").select("doc_id", "part", "item_id", shift.alias("shift"), "item", beside.alias("beside"))
            .groupBy("doc_id", "part", "item_id", "shift").agg(F.first("item").alias("item"), F.first("beside").alias("beside")))
    same = hits.select("doc_id", "part", "item_id", F.transform("item", lambda w, i: F.when(
        F.get("beside", i + F.least(F.col("shift"), F.lit(0))) == w, 1).otherwise(0)).alias("equal"))
    width = F.least(F.lit(stretch), F.size("equal"))
    best = F.exists(F.sequence(F.lit(1), F.size("equal") - width + 1), lambda i: F.aggregate(
        F.slice("equal", i, width), F.lit(0), lambda s, x: s + x) * 100 >= width * percent)
    return same.where(best).select("doc_id", "part", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items and the sorted item ids that every row of ``docs`` overlaps."""
    docs = documents(docs)
    found = overlaps(docs, benchmark).groupBy("doc_id", "part").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    right = found.toDF("_doc", "_part", "items")
    return docs.select("doc_id", "part").join(right, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_part")), "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all their columns, that overlap no item."""
    keyed = documents(packed(docs), "user")
    found = overlaps(keyed, benchmark).select(F.col("doc_id").alias("_doc"), F.col("part").alias("_part")).distinct()
    clean = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_part")), "left_anti")
    return clean.select(*unpacked(docs.columns))
