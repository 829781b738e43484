"""Ordered operators that stay parallel inside a hot key.

A plain window over one key sorts all of that key in one task.  Here the order
column is cut into blocks, the window runs inside (key, block), and a small
per-block table carries what must cross a block edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.lineage import cut, is_empty

BLOCK = 4096
#: Rows of a key that one task may sort for a quantile.
SORTED = 1 << 16


def numbered(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order: list[Column],
    name: str,
    start: int = 1,
) -> DataFrame:
    """Consecutive numbers per key; ``block`` must be monotone in ``order``."""
    marked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    sizes = marked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        marked.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_rank") + F.col("_offset") + F.lit(start - 1))
        .drop("_rank", "_offset", "_block")
    )


def previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    block: Column,
) -> DataFrame:
    """Value of each column in the preceding row of the key (null on the first).

    ``columns`` maps a source column to the name of its predecessor.
    """
    marked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    packed = F.struct(*[F.col(c) for c in columns])
    tail = F.struct(*[F.col(c) for c in order])
    last = marked.groupBy(*keys, "_block").agg(F.max_by(packed, tail).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_block")
    edges = last.select(*keys, "_block", F.lag("_last").over(across).alias("_edge"))
    out = marked.withColumn("_prev", F.lag(packed).over(inside)).join(edges, [*keys, "_block"])
    source = F.coalesce(F.col("_prev"), F.col("_edge"))
    return out.withColumns({new: source[old] for old, new in columns.items()}).drop(
        "_prev", "_edge", "_block"
    )


def runs(df: DataFrame, keys: list[str], order: str, gap: int, name: str, size: int = BLOCK) -> DataFrame:
    """Number of each row's run: the value of ``order`` at which it began.

    A run of a key ends where the next value of ``order`` is more than ``gap`` further on.  Runs are found on the distinct
    values, in blocks of ``size``; a small per-block table carries the last beginning across block edges.
    """
    block = F.floor(F.col(order) / size)
    values = df.select(*keys, order).distinct()
    known = previous(values, keys, [order], {order: "_before"}, block).withColumn("_block", block)
    begins = F.when(F.col("_before").isNull() | (F.col(order) - F.col("_before") > gap), F.col(order))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    marked = known.withColumn("_begin", begins).withColumn(name, F.max("_begin").over(inside))
    last = marked.groupBy(*keys, "_block").agg(F.max("_begin").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_block", F.max("_last").over(before).alias("_carry"))
    numbers = marked.join(carried, [*keys, "_block"]).select(*keys, order, F.coalesce(name, "_carry").alias(name))
    return df.join(numbers, [*keys, order])


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: int = 64) -> DataFrame:
    """First ``k`` rows of every key, cut down in hashed slices before the final rank."""
    cells = [F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(spread))]
    slice_window = Window.partitionBy(*keys, *cells).orderBy(*order)
    final_window = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return (
        df.withColumn("_r", F.row_number().over(slice_window))
        .filter(F.col("_r") <= k)
        .withColumn("rank", F.row_number().over(final_window))
        .filter(F.col("rank") <= k)
        .drop("_r")
    )


def digits(value: Column, bits: int) -> Column:
    """A whole number that never falls as ``value`` (a double) rises: sign, power of two and the first ``bits`` of the fraction.

    Bins of equal digits have the same relative width everywhere, so a far outlier widens none.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    # The logarithm may round across a power of two; the powers themselves are exact.
    power = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    power = F.when(size == float("inf"), F.lit(1024)).otherwise(power)
    fraction = F.when(size == float("inf"), F.lit(0.0)).otherwise(size / F.pow(F.lit(2.0), power) - 1.0)
    code = (power + 1076) * F.lit(1 << bits) + F.floor(fraction * float(1 << bits))
    return F.when(size == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * code.cast("long")).cast("long")


def _holding(counts: DataFrame, keys: list[str], bin_: str) -> DataFrame:
    """Of bins with ``_size`` rows, those that hold a wanted rank: ``_low`` and ``_high`` count from ``_first``, which moves on."""
    upto = Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("_first") + F.sum("_size").over(upto)
    placed = counts.withColumn("_end", end).withColumn("_first", F.col("_end") - F.col("_size"))
    return placed.filter((F.col("_first") <= F.col("_high")) & (F.col("_end") > F.col("_low"))).drop("_end", "_size")


def group_medians(df: DataFrame, keys: list[str], value: str, name: str, first: Column | None = None) -> DataFrame:
    """Median of ``value`` (not null) of every key with a row; for keys whose rows are bounded, as the pixels of one box.

    The rows of a key are sorted once (a sort that spills) and only those in the middle are kept, so nothing is gathered.  Where
    rows of a key have the flag ``first``, they count alone.
    """
    each = Window.partitionBy(*keys)
    if first is None:
        ranked = df.withColumns({"_r": 2 * F.row_number().over(each.orderBy(value)), "_n": F.count(F.lit(1)).over(each)})
    else:
        # Flagged rows stand before the others, so their ranks are those among themselves.
        flagged = F.count_if(first).over(each)
        ranked = df.withColumns({"_r": 2 * F.row_number().over(each.orderBy(first.desc(), value)), "_n": F.when(flagged > 0, flagged).otherwise(F.count(F.lit(1)).over(each))})
    return ranked.filter(F.col("_r").between(F.col("_n"), F.col("_n") + 2)).groupBy(*keys).agg(F.avg(value).alias(name))


def crowded(df: DataFrame, keys: list[str], most: int = SORTED) -> DataFrame | None:
    """Keys with more than ``most`` rows; None if there are none."""
    many = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*keys))
    return None if is_empty(many) else many


def quantiles(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float], coarse: int = 8, fine: int = 32, large: DataFrame | None | str = "count"
) -> DataFrame:
    """Exact linear-interpolated quantiles per key: sorted ranks, and digits for the keys in ``large`` (``crowded``; counted if not given).

    A caller that asks several times on the same rows counts once.
    """
    finite = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    large = crowded(finite, keys) if isinstance(large, str) else large
    if large is None:
        return _sorted_quantiles(finite, keys, points)
    few, many = finite.join(large, keys, "left_anti"), finite.join(large, keys, "left_semi")
    return _sorted_quantiles(few, keys, points).unionByName(digit_quantiles(many, keys, "_v", points, coarse, fine))


def _sorted_quantiles(finite: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    each = Window.partitionBy(*keys)
    ranked = finite.withColumns({"_r": F.row_number().over(each.orderBy("_v")) - 1, "_n": F.count(F.lit(1)).over(each) - 1})
    at = {name: F.lit(float(p)) * F.col("_n") for name, p in points.items()}
    wanted = F.lit(False)
    for x in at.values():
        wanted = wanted | F.col("_r").isin(F.floor(x), F.ceil(x))
    holds = lambda rank: F.max(F.when(F.col("_r") == rank, F.col("_v")))
    ends = [c for name, x in at.items() for c in (holds(F.floor(x)).alias(f"_a_{name}"), holds(F.ceil(x)).alias(f"_b_{name}"))]
    picked = ranked.filter(wanted).groupBy(*keys, "_n").agg(*ends)
    return picked.select(*keys, *[(F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * (x - F.floor(x))).alias(n) for n, x in at.items()])


def digit_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], coarse: int = 8, fine: int = 32) -> DataFrame:
    """Quantiles of keys of any size, by radix selection on the ordered digits of the values.

    Equal values are counted first.  Bins of the first digits are counted, and only those that hold a wanted rank are looked into:
    once with ``coarse`` and once with ``fine`` bits of the fraction.  What is left of a key shares 32 bits of its fraction, so
    a running count over it stays small however many values the key has.
    """
    finite = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    counted = finite.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    binned = counted.withColumn("_bin", digits(F.col("_v"), coarse))
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_size"))
    total = F.sum("_size").over(Window.partitionBy(*keys))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in points.items()]))
    at = F.col("_q.p") * (F.col("_total") - 1)
    asked = per_bin.withColumn("_total", total).withColumn("_q", wanted).select(
        *keys, "_bin", "_size", F.col("_q.name").alias("_name"), at.alias("_at"), F.floor(at).alias("_low"), F.ceil(at).alias("_high"), F.lit(0).cast("long").alias("_first")
    )
    named = [*keys, "_name"]
    opened = _holding(asked, named, "_bin")
    ranks = ["_at", "_low", "_high", "_first"]
    inside = binned.join(opened, [*keys, "_bin"]).withColumn("_sub", digits(F.col("_v"), fine))
    per_sub = inside.groupBy(*named, "_bin", "_sub", *ranks).agg(F.sum("_n").alias("_size"))
    last = _holding(per_sub, [*named, "_bin"], "_sub")
    left = inside.drop(*ranks).join(last, [*named, "_bin", "_sub"])
    running = Window.partitionBy(*named, "_bin", "_sub").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = left.withColumn("_end", F.col("_first") + F.sum("_n").over(running)).withColumn("_begin", F.col("_end") - F.col("_n"))
    holds = lambda rank: F.max(F.when((F.col("_begin") <= F.col(rank)) & (F.col(rank) < F.col("_end")), F.col("_v")))
    picked = ranked.groupBy(*named, "_at").agg(holds("_low").alias("_a"), holds("_high").alias("_b"))
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, value_at)).alias(name) for name in points])
