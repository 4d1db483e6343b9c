"""Ordered computations that never put a whole key into one task.

A key such as a source or a segment can be arbitrarily long, so an ordered key is cut into chunks of ``size``
positions and every window function runs inside (key, chunk):

* :func:`neighbours` - frames of bounded reach: rows near a chunk border are copied into the next chunk.
* :func:`running`    - unbounded running sums / maxima: one partial row per chunk is combined over the key, and the
  carry is joined back.
* :func:`next_match` / :func:`last_match` - as-of lookups between two tables, as a union plus a running value.
* :func:`by_value_chunks`, :func:`quantiles` - the same for orders over arbitrary values.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from netstate.session import materialize

CHUNK = "_chunk"


def chunk_of(position: str | Column, size: int) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(size)).cast("long")


def neighbours(df: DataFrame, keys: Sequence[str], order: str, size: int, before: int, after: int,
               columns: Callable[[WindowSpec], dict[str, Column]], tie: Sequence[Column] = (),
               where: Column | None = None) -> DataFrame:
    """Add columns computed over at most ``before`` positions back and ``after`` positions ahead.

    ``where`` keeps only some result rows; it may use the new columns.
    """
    first, last = chunk_of(F.col(order) - after, size), chunk_of(F.col(order) + before, size)
    copies = df.select("*", chunk_of(order, size).alias("_home"), F.explode(F.sequence(first, last)).alias(CHUNK))
    spec = Window.partitionBy(*keys, CHUNK).orderBy(order, *tie)
    out = copies.select("*", *[c.alias(n) for n, c in columns(spec).items()]).where(F.col("_home") == F.col(CHUNK))
    if where is not None:
        out = out.where(where)
    return out.drop("_home", CHUNK)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk: Column,
            sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None,
            upcoming: dict[str, Column] | None = None, totals: dict[str, Column] | None = None,
            before: bool = False) -> DataFrame:
    """Running values per key over ``order``; ``chunk`` must be monotone in it.

    They include the row itself; with ``before`` sums and last see only the rows before it.

    sums:     running sum of a non-null number
    last:     running maximum; for values that grow with ``order`` the last one so far (nulls are passed over)
    upcoming: running minimum seen from the end; for such values the next one from here on
    totals:   the sum over the whole key
    """
    sums, last, upcoming, totals = sums or {}, last or {}, upcoming or {}, totals or {}
    base = df.withColumn(CHUNK, chunk)
    parts = base.groupBy(*keys, CHUNK).agg(
        *[F.sum(c).alias(n) for n, c in {**sums, **totals}.items()], *[F.max(c).alias(n) for n, c in last.items()],
        *[F.min(c).alias(n) for n, c in upcoming.items()])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    later = whole.orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)
    carry = parts.select(
        *keys, CHUNK,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(n).over(earlier).alias(f"_c_{n}") for n in last],
        *[F.min(n).over(later).alias(f"_c_{n}") for n in upcoming],
        *[F.sum(n).over(whole).alias(n) for n in totals])
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    from_here = inside.rowsBetween(0, Window.unboundedFollowing)
    local = base.select("*", *[F.sum(c).over(so_far).alias(f"_l_{n}") for n, c in sums.items()],
                        *[F.max(c).over(so_far).alias(f"_l_{n}") for n, c in last.items()],
                        *[F.min(c).over(from_here).alias(f"_l_{n}") for n, c in upcoming.items()])
    # greatest / least pass over nulls
    return local.join(carry, [*keys, CHUNK]).select(
        *df.columns,
        *[(F.coalesce(f"_l_{n}", F.lit(0)) + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in last],
        *[F.least(f"_l_{n}", f"_c_{n}").alias(n) for n in upcoming],
        *totals)


def _match(left: DataFrame, right: DataFrame, keys, left_at: Column, right_at: Column, payload, size, ahead, into):
    fields = [F.col(p).alias(p) for p in payload]
    entry = F.struct(right_at.cast("long").alias("at"), *fields)
    probes = left.select(*[F.col(k) for k in keys], left_at.cast("long").alias("_at"),
                         F.lit(0 if ahead else 1).alias("_side"), F.struct(*left.columns).alias("_row"))
    marks = right.select(*[F.col(k) for k in keys], right_at.cast("long").alias("_at"),
                         F.lit(1 if ahead else 0).alias("_side"), entry.alias("_entry"))
    both = probes.unionByName(marks, allowMissingColumns=True)
    found = running(both, keys, ["_at", "_side"], chunk_of("_at", size),
                    **{"upcoming" if ahead else "last": {into: F.col("_entry")}})
    return found.where(F.col("_row").isNotNull()).select("_row.*", into)


def next_match(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: Column, right_at: Column,
               size: int, into: str, payload: Sequence[str] = ()) -> DataFrame:
    """``left`` plus a struct ``into`` (field ``at`` and ``payload``): the first right row at or after ``left_at``."""
    return _match(left, right, keys, left_at, right_at, payload, size, True, into)


def last_match(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: Column, right_at: Column,
               size: int, into: str, payload: Sequence[str] = ()) -> DataFrame:
    """``left`` plus a struct ``into``: the last right row at or before ``left_at``."""
    return _match(left, right, keys, left_at, right_at, payload, size, False, into)


def beside(row: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row results next to each other, as scalar subqueries."""
    for other in others:
        row = row.withColumn("_other", other.select(F.struct("*").alias("s")).scalar()).select("*", "_other.*").drop(
            "_other")
    return row


def runs(df: DataFrame, keys: Sequence[str], order: str, size: int, max_gap: int, start: str) -> DataFrame:
    """Mark gaps-and-islands: ``start`` is the first position of the run a row belongs to.

    A run goes on while at most ``max_gap`` positions are missing between two rows.
    """
    marked = neighbours(df, keys, order, size, max_gap + 1, 0,
                        lambda w: {"_step": F.col(order) - F.lag(order).over(w)})
    begins = F.when(F.col("_step").isNull() | (F.col("_step") > max_gap + 1), F.col(order))
    return running(marked.withColumn("_begin", begins), keys, [order], chunk_of(order, size),
                   last={start: F.col("_begin")}).drop("_step", "_begin")


#: Rows of a value range, and into how many ranges a range that holds more is cut.
RANGE_ROWS, RANGE_PARTS = 1 << 16, 64


def by_value_chunks(df: DataFrame, keys: Sequence[str], value: str, most: int | None = None) -> DataFrame:
    """Add ``_vchunk``, monotone in ``value``: a number of a range that holds about ``most`` rows of a key at most.

    Ranges are counted. One that is too full is cut by the quantiles of a mergeable sketch of its own values, and its parts are
    counted again, until none is (equal values stay together). So the number of ranges follows the number of rows, whatever
    their distribution. The sketches only balance, results do not depend on them. Counts run jobs: ``df`` should be cheap to read.
    """
    most = most or RANGE_ROWS
    keys, out = list(keys), df.withColumn("_vchunk", F.lit(0).cast("long"))
    cuts = F.percentile_approx(value, [i / RANGE_PARTS for i in range(1, RANGE_PARTS)], 1000)
    while True:
        ranges = out.groupBy(*keys, "_vchunk").agg(F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        full = ranges.where((F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))).select(*keys, "_vchunk")
        if full.isEmpty():
            return out
        # RANGE_PARTS numbers for each full range, of which there is one in ``most`` rows at most
        bounds = materialize(out.join(full, [*keys, "_vchunk"], "left_semi").groupBy(*keys, "_vchunk").agg(cuts.alias("_cuts")), "range-cuts")
        # a value that is a bound has a range of its own, so a range of several values always gets smaller
        inner = (F.size(F.filter("_cuts", lambda c: c < F.col(value))) + F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).cast("long")
        out = out.join(bounds, [*keys, "_vchunk"], "left").withColumn(
            "_vchunk", F.col("_vchunk") * (2 * RANGE_PARTS) + F.when(F.col("_cuts").isNull(), 0).otherwise(inner)).drop("_cuts")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A written table (keys, value, ``_n``) of the values that aren't null."""
    return materialize(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")), "value-counts")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key: (keys, i, q), ``i`` numbering ``probabilities`` from 0."""
    return counted_quantiles(value_counts(df, keys, value), keys, value, probabilities)


def counted_quantiles(counted: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """As :func:`quantiles`, of :func:`value_counts`: ranked with :func:`running`, and only rows that hold a wanted rank go on."""
    ranked = running(by_value_chunks(counted, keys, value), keys, [value], F.col("_vchunk"),
                     sums={"_upto": F.col("_n")}, totals={"_all": F.col("_n")})
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("at"))
                       for i, p in enumerate(probabilities)])
    lower, upper = F.col("_upto") - F.col("_n"), F.col("_upto") - 1

    def inside(rank: Column) -> Column:
        return (rank >= lower) & (rank <= upper)

    hits = ranked.withColumn("_want", F.explode(F.filter(
        wanted, lambda w: inside(F.floor(w["at"])) | inside(F.ceil(w["at"])))))
    share = F.col("_want.at") - F.floor("_want.at")
    weight = (F.when(inside(F.floor("_want.at")), 1 - share).otherwise(0.0)
              + F.when(inside(F.ceil("_want.at")) & (share > 0), share).otherwise(0.0))
    return hits.groupBy(*keys, F.col("_want.i").alias("i")).agg(F.sum(F.col(value) * weight).alias("q"))
