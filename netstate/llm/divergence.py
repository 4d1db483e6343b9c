"""Divergence of the sources of a language by their words, on run-length columns.

Each language keeps the terms that enough of its documents hold; each (lang, source) group is a column of counts over them.
The vocabulary is dealt out in blocks by a hash of the term, none with more than about ``CELLS`` counts. Inside a block terms
are put in an order that brings equal counts together: by their counts in the sources, those with the fewest different counts
first. Every column then becomes runs of equal counts (:func:`run_lengths`). A pair of sources is compared where a run of one
of them begins, and each difference counts as often as the cut run is long (:func:`pair_values`).

Columns are dealt to pairs of tiles of at most about ``TILE`` sources, so no task holds all sources of a language, and sums of
blocks are added up by Spark. Counts stay integers throughout: p = 1 + floor(10^9 (count + 2) / (N + 2 V)) by long division,
f = floor((p - q)^2 / (p + q)) below 2^63.
"""
from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netstate.session import materialize

LEAST_DOCS, TOP = 10, 10
CELLS, TILE, SALTS = 1 << 18, 256, 16
FLUSH, SEGMENT = 500_000, 1 << 20

#: Bytes that belong to terms stay, A-Z lower-cased; all others become blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _segments(text: bytes) -> Iterator[bytes]:
    """Parts of about ``SEGMENT`` bytes, cut at blanks, so that the words of a very long text are never all in memory."""
    begin = 0
    while len(text) - begin > SEGMENT and (at := text.find(b" ", begin + SEGMENT)) >= 0:
        yield text[begin:at]
        begin = at
    yield text[begin:]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term. Nulls are empty strings.

    Tasks add up what they can hold; a key may have a row for each task and more.
    """
    def rows(held) -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, documents) in held.items():
            terms = list(occurrences)
            yield pa.record_batch([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                                   pa.array(terms, pa.binary()).cast(pa.string()),
                                   pa.array(list(occurrences.values()), pa.int64()),
                                   pa.array([documents[t] for t in terms], pa.int64())],
                                  names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                occurrences, documents = held[lang, source]
                size -= len(occurrences)
                found: set[bytes] = set()
                for segment in _segments(text.as_py().translate(TERM_BYTES)):
                    terms = segment.split()
                    occurrences.update(terms)
                    found.update(terms)
                documents.update(found)
                size += len(occurrences)
                if size > FLUSH:
                    yield from rows(held)
                    held.clear()
                    size = 0
        yield from rows(held)

    filled = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return filled.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, cells) of terms in at least ``least`` rows of their language; cells: (source, n) with n > 0.

    One shuffle, by language and term. A term has at most one cell a source.
    """
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counts.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells")).where(
        F.col("docs") >= least).drop("docs")


def run_lengths(terms: DataFrame, blocks: int) -> DataFrame:
    """(lang, block, source, n_terms, starts, counts): the runs of equal counts of each source over the ordered block."""
    def order(term: np.ndarray, source: np.ndarray, count: np.ndarray, n: int, sources: int) -> np.ndarray:
        """Positions of the terms. Cells come by term."""
        kinds = np.unique(np.stack([source, count], 1), axis=0)[:, 0]
        place = np.empty(sources, dtype=np.int64)
        place[np.argsort(np.bincount(kinds, minlength=sources), kind="stable")] = np.arange(sources)
        by = np.lexsort((place[source], term))
        key = np.stack([place[source][by], count[by]], 1).astype(">i8").tobytes()
        ends = np.cumsum(np.bincount(term, minlength=n)) * 16
        keys = [key[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        position = np.empty(n, dtype=np.int64)
        position[sorted(range(n), key=keys.__getitem__)] = np.arange(n)
        return position

    def runs(at: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(at)
        at, count = at[by], count[by]
        after = np.append(at[1:], n) != at + 1                      # a zero follows
        after[-1] &= at[-1] + 1 < n
        lead = [0] if at[0] else []
        starts = np.concatenate([lead, at, at[after] + 1]).astype(np.int64)
        values = np.concatenate([lead, count, np.zeros(after.sum(), dtype=np.int64)]).astype(np.int64)
        by = np.argsort(starts, kind="stable")
        starts, values = starts[by], values[by]
        first = np.append(True, values[1:] != values[:-1])
        return starts[first], values[first]

    def run(key, table):
        cells = table.column("cells").combine_chunks()
        n, inner = len(cells), cells.flatten()
        term = np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy()))
        named = inner.field("source").dictionary_encode()
        source, count = named.indices.to_numpy().astype(np.int64), inner.field("n").to_numpy()
        names = named.dictionary.to_pylist()
        at = order(term, source, count, n, len(names))[term]
        by = np.argsort(source, kind="stable")
        edges = np.searchsorted(source[by], np.arange(len(names) + 1))
        out = [runs(at[by[a:b]], count[by[a:b]], n) for a, b in zip(edges, edges[1:])]
        k = len(names)
        return pa.table({"lang": pa.array([key[0].as_py()] * k, pa.string()), "block": pa.array([key[1].as_py()] * k, pa.int32()),
                         "source": pa.array(names, pa.string()), "n_terms": pa.array([n] * k, pa.int64()),
                         "starts": pa.array([s for s, _ in out], pa.list_(pa.int64())),
                         "counts": pa.array([c for _, c in out], pa.list_(pa.int64()))})

    dealt = terms.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "cells")
    return dealt.groupBy("lang", "block").applyInArrow(
        run, "lang string, block int, source string, n_terms bigint, starts array<bigint>, counts array<bigint>")


def scaled(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), in three steps of long division: exact for totals up to 9 * 10^15."""
    quotient, rest = np.zeros_like(count), count + 2
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + rest // total, rest % total
    return quotient + 1


def pair_values(columns: DataFrame, groups: DataFrame, blocks: int, tiles: int) -> DataFrame:
    """(lang, a, b, value) of all pairs a < b of sources of a language: f summed over all terms.

    ``groups``: lang, source, space (N + 2 V). Each group has a place in every block, if need be as one run of zeros.
    """
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    grid = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(
        columns, ["lang", "block", "source"], "left")
    other = F.col("_other")
    dealt = grid.withColumn("tile", tile).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(
        "*", F.least("tile", other).alias("low"), F.greatest("tile", other).alias("high"))

    def run(key, table):
        lang, block, low, high = (k.as_py() for k in key)
        terms = max((n for n in table.column("n_terms").to_pylist() if n is not None), default=0)
        held = []
        for row in table.select(["source", "tile", "space", "starts", "counts"]).to_batches():
            starts, counts = row.column("starts"), row.column("counts")
            for i, (source, tile, space) in enumerate(zip(*(row.column(c).to_pylist() for c in ("source", "tile", "space")))):
                if starts[i].is_valid:
                    begin, count = starts[i].values.to_numpy(), counts[i].values.to_numpy()
                else:
                    begin, count = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
                held.append((source, tile, begin, scaled(count, space) if terms else count))
        held.sort(key=lambda x: x[0].encode())
        first, second, values = [], [], []
        for i, (a, s, begin_a, p) in enumerate(held):
            for b, t, begin_b, q in held[i + 1:]:
                if low != high and s == t or not terms and block:
                    continue
                cuts = np.union1d(begin_a, begin_b)
                x = p[np.searchsorted(begin_a, cuts, "right") - 1]
                y = q[np.searchsorted(begin_b, cuts, "right") - 1]
                first.append(a)
                second.append(b)
                values.append(int(((x - y) ** 2 // (x + y) * np.diff(cuts, append=terms)).sum()) if terms else 0)
        return pa.table({"lang": pa.array([lang] * len(first), pa.string()), "a": pa.array(first, pa.string()),
                         "b": pa.array(second, pa.string()), "value": pa.array(values, pa.int64())})

    sums = dealt.groupBy("lang", "block", "low", "high").applyInArrow(run, "lang string, a string, b string, value bigint")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _p(count: str, space: str) -> Column:
    return F.expr(f"1 + cast(1000000000 as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0)) div cast({space} as decimal(20, 0))")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how the words of each source differ from those of other sources.

    Part ``pair``: every other source of the language by summed difference. Part ``term``: the ``top`` terms that are more
    frequent in the source than in the language. Null text, lang and source are empty strings; texts without terms, and
    languages that keep none, still make groups (values 0); repeated rows count each; ties go to the smaller item. Ids and
    other columns are not read. An empty table has no rows.
    """
    terms = materialize(kept_terms(docs, least), "divergence-terms")
    cells = terms.select("lang", "term", "total", F.explode("cells").alias("cell")).select("lang", "term", "total", "cell.*")
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("words"))
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = materialize(named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("terms", F.lit(0))).alias("space"),
        (F.col("words") + 2 * F.col("terms")).alias("lang_space")), "divergence-groups")
    n_cells = terms.agg(F.sum(F.size("cells"))).first()[0] or 0
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks, tiles = max(1, math.ceil(n_cells / CELLS)), max(1, math.ceil(most / TILE))

    columns = materialize(run_lengths(terms, blocks), "divergence-runs")
    pairs = materialize(pair_values(columns, groups.select("lang", "source", "space"), blocks, tiles), "divergence-pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(
        pairs.select("lang", "b", "a", "value"))

    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).alias("salt")   # a source may hold most of all cells
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    priced = cells.select("*", salt).join(salted, ["lang", "source", "salt"]).select(
        "lang", "source", "salt", F.col("term").alias("item"), _p("n", "space").alias("p"), _p("total", "lang_space").alias("q"))
    valued = priced.where("p > q").withColumn("value", F.expr("(p - q) * (p - q) div (p + q)"))
    group = ["lang", "source"]

    def ranked(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item")))

    best = ranked(ranked(valued, *group, "salt").where(F.col("rank") <= top).drop("rank"), *group).where(F.col("rank") <= top)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return ranked(both, *group).withColumn("part", F.lit("pair")).select(names).union(
        best.withColumn("part", F.lit("term")).select(names))


SQL = r"""
WITH docs AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     row_number() OVER () AS doc FROM documents),
words AS (SELECT lang, source, doc, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM groups LEFT JOIN counted USING (lang, source) GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 2)) // (l.n + 2 * l.v) AS q
  FROM sizes g JOIN langs l ON g.lang = l.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM kept)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
          FROM grid WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
