"""Global orderings without a single-task window.

``hash_rank`` and ``prefix_sums`` cut one order into many buckets or ranges, work inside these in
parallel and add per-bucket offsets. The offset tables have (groups x buckets) rows, so their
windows and joins stay small whatever the data size. Quantiles are sketched and then refined until exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propensia.functions.hashing import MODULUS
from propensia.session import parallel_buckets, stage


def _offsets(sums: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per (group, bucket): the totals of all buckets before it."""
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    return sums.select(
        *group, "_b", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in names]
    )


def _keyed(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(group)) if group else (df.withColumn("_g", F.lit(0)), ["_g"])


def hash_rank(
    df: DataFrame,
    group: Sequence[str],
    hash_value: Column,
    key: str,
    out: str = "rank",
    modulus: int = MODULUS,
    buckets: int | None = None,
) -> DataFrame:
    """1-based rank inside each group by (hash, key); ``hash_value`` is spread over [0, modulus).

    A group of any size is ranked by many tasks, one per slice of the hash range.
    """
    buckets = buckets or parallel_buckets(df.sparkSession)
    df, keys = _keyed(df, group)
    df = df.withColumn("_h", hash_value).withColumn(
        "_b", F.floor(F.col("_h") * F.lit(buckets) / F.lit(modulus)).cast("int")
    )
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("n"))
    inside = W.partitionBy(*keys, "_b").orderBy("_h", key)
    return (
        df.withColumn("_r", F.row_number().over(inside))
        .join(_offsets(counts, keys, ["n"]), [*keys, "_b"])
        .withColumn(out, (F.col("_r") + F.col("_o_n")).cast("long"))
        .drop("_h", "_b", "_r", "_o_n", "_g")
    )


def hash_cuts(
    df: DataFrame,
    group: str,
    hash_value: Column,
    key: str,
    positions: Callable[[int], Sequence[int]],
    modulus: int = MODULUS,
    buckets: int | None = None,
) -> dict[object, list[tuple[int, object]]]:
    """Per group value, the (hash, key) found at given 1-based ranks of that group's hash order.

    ``positions(n)`` lists the ranks wanted of a group of n rows; rows without a group are left out. Cutting at these values assigns rows
    by rank without moving them: only counts per slice of the hash range are shuffled, and then the
    rows of the few slices a wanted rank falls into.
    """
    buckets = buckets or 4 * parallel_buckets(df.sparkSession)
    rows = df.select(
        F.col(group).alias("g"), F.col(key).alias("key"), hash_value.alias("h")
    ).filter(F.col("g").isNotNull()).withColumn("b", F.floor(F.col("h") * F.lit(buckets) / F.lit(modulus)).cast("int"))
    counts: dict[object, dict[int, int]] = {}
    sizes = rows.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n")).limit(buckets * 1000 + 1).collect()
    if len(sizes) > buckets * 1000:
        raise ValueError(f"{group} has too many values for a class column")
    for r in sizes:
        counts.setdefault(r["g"], {})[r["b"]] = r["n"]
    wanted = []
    for g, sizes in counts.items():
        before, at = 0, list(positions(sum(sizes.values())))
        for b in sorted(sizes):
            wanted += [(g, b, pos - before, i) for i, pos in enumerate(at) if before < pos <= before + sizes[b]]
            before += sizes[b]
    cuts: dict[object, list] = {g: [] for g in counts}
    if wanted:
        kind = df.schema[group].dataType.simpleString()
        table = df.sparkSession.createDataFrame(wanted, f"g {kind}, b int, r int, i int")
        slices = table.select("g", "b").distinct()
        order = W.partitionBy("g", "b").orderBy("h", "key")
        ranked = rows.join(slices, ["g", "b"], "left_semi").withColumn("r", F.row_number().over(order))
        for r in ranked.join(table, ["g", "b", "r"]).orderBy("i").collect():
            cuts[r["g"]].append((r["h"], r["key"]))
    return cuts


def rank_section(group: str, hash_value: Column, key: str, cuts: dict[object, list[tuple[int, object]]]) -> Column:
    """How many of its group's cuts a row lies behind: 0 up to and including the first cut."""
    out = F.lit(None).cast("int")
    for g, at in cuts.items():
        section = F.lit(0)
        for h, k in at:
            behind = (hash_value > F.lit(h)) | ((hash_value == F.lit(h)) & (F.col(key) > F.lit(k)))
            section = section + behind.cast("int")
        out = F.when(F.col(group) == F.lit(g), section).otherwise(out)
    return out


RANGE_ROWS = 100_000


def prefix_sums(df: DataFrame, group: Sequence[str], order: str, values: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Inclusive running sums ``cum_<value>`` in ascending ``order`` inside each group.

    ``df`` has one row per (group, order). Rows are range-sorted by group and order, and written once with the number of
    their range, since ranges are drawn from a sample and all passes have to see the same ones. Each range is summed by
    itself; a table of (group, range) totals gives what lies before it. Hot groups simply fill several ranges.
    ``ranges`` defaults to the shuffle partitions, or more for over ``RANGE_ROWS`` rows each; sums are exact for any number.
    """
    df, keys = _keyed(df, group)
    if ranges is None:
        df = stage(df, "steps")
        ranges = max(parallel_buckets(df.sparkSession), math.ceil(df.count() / RANGE_ROWS))
    placed = df.repartitionByRange(ranges, *keys, order).withColumn("_b", F.spark_partition_id())
    placed = stage(placed, "ranges")
    totals = placed.groupBy(*keys, "_b").agg(*[F.sum(v).alias(v) for v in values])
    inside = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.withColumns({f"_i_{v}": F.sum(v).over(inside) for v in values})
        .join(_offsets(totals, keys, values), [*keys, "_b"])
        .withColumns({f"cum_{v}": F.col(f"_i_{v}") + F.col(f"_o_{v}") for v in values})
        .drop("_b", "_g", *[f"_i_{v}" for v in values], *[f"_o_{v}" for v in values])
    )


#: items a quantile sketch keeps per level; up to so many values it holds all of them and is exact
SKETCH = 4096


def _sketch_error(k: int) -> float:
    """Twice the rank error that a sketch of size ``k`` stays within for all quantiles at 99 % (Karnin, Lang, Liberty 2016)."""
    return 2 * 2.296 / k**0.9021


class _Search:
    """One column's search: the ranks still open lie strictly between the values ``proven``; ``guess`` is tested next."""

    def __init__(self):
        self.proven = self.guess = (None, None)
        self.found: dict[int, float] = {}

    def counts(self, c: Column) -> dict[str, Column]:
        """Rows in all, before the guess, on its low end, inside, and on its high end."""
        low, high = self.guess
        inside = c.isNotNull()
        inside = inside & (c > low) if low is not None else inside
        inside = inside & (c < high) if high is not None else inside
        return {
            "n": F.count(c), "before": F.count_if(c < low) if low is not None else F.lit(0), "on_low": F.count_if(c == low) if low is not None else F.lit(0),
            "inside": F.count_if(inside), "on_high": F.count_if(c == high) if high not in (None, low) else F.lit(0), "sketch": F.when(inside, c),
        }

    def settle(self, ranks: set[int], before: int, on_low: int, inside: int, on_high: int) -> set[int]:
        """Takes counts in; returns the open ranks if they are all inside the guess, else none and sets another guess."""
        (low, high), (least, most) = self.guess, self.proven
        start, end = before + on_low, before + on_low + inside
        for r in ranks - self.found.keys():
            if before <= r < start:
                self.found[r] = low
            elif end <= r < end + on_high:
                self.found[r] = high
        left = ranks - self.found.keys()
        under, over = any(r < before for r in left), any(r >= end + on_high for r in left)
        if not under and not over:
            self.proven = self.guess
            return left
        within = any(start <= r < end for r in left) or (under and over)
        self.proven = self.guess = (least if under else low if within else high, most if over else high if within else low)
        return set()


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float = 0.5, k: int = SKETCH) -> DataFrame:
    """(column, value): exact interpolated quantile of each numeric column; null and NaN are skipped, a column of these has none.

    Every pass is one aggregate of the plain rows, one row of sketches and counts for all columns. A sketch of the values
    strictly inside a column's guess gives a narrower one around the wanted ranks; the next pass counts what lies before and
    on its ends, so a wrong guess only costs a pass, and a value that holds a large share of the rows is settled
    by these counts. Once at most ``k`` values are inside, the sketch holds them all and the answer is exact. A pass narrows
    a guess to some thousandths: two or three passes at any size. The driver sees a sketch (some 50 KB) per column and pass.
    """
    spark = df.sparkSession
    plain = {f"c{i}": F.col(c).cast("double") for i, c in enumerate(cols)}
    rows = df.select(*[F.when(~F.isnan(c), c).alias(name) for name, c in plain.items()])
    open_, slack = {i: _Search() for i in range(len(cols))}, _sketch_error(k)
    out: dict[int, float] = {}
    while open_:
        cells = []
        for i, search in open_.items():
            counts = search.counts(F.col(f"c{i}"))
            sketched = counts.pop("sketch")
            cells += [c.alias(f"{name}{i}") for name, c in counts.items()]
            cells.append(F.when(F.count(sketched) > 0, F.kll_sketch_agg_double(sketched, F.lit(k))).alias(f"sketch{i}"))
        row = rows.agg(*cells).first()
        asked, sketches, shares = [], [], []
        for i, search in list(open_.items()):
            n, before, on_low, inside, on_high = (row[f"{x}{i}"] for x in ("n", "before", "on_low", "inside", "on_high"))
            if not n:
                del open_[i]
                continue
            at = (n - 1) * q
            ranks = {math.floor(at), math.ceil(at)}
            left = search.settle(ranks, before, on_low, inside, on_high)
            if left:
                ends = sorted(left) if inside <= k else [min(left), max(left)]
                off = [0.0] * len(ends) if inside <= k else [-slack, slack]
                asked += [(i, r if inside <= k else None) for r in ends]
                sketches += [row[f"sketch{i}"]] * len(ends)
                shares += [min(1.0, max(0.0, (r - before - on_low + 0.5) / inside + o)) for r, o in zip(ends, off)]
        got = []
        if asked:
            table = spark.createDataFrame([tuple(sketches)], ", ".join(f"s{j} binary" for j in range(len(asked))))
            got = table.select(*[F.kll_sketch_get_quantile_double(f"s{j}", F.lit(share)) for j, share in enumerate(shares)]).first()
        guesses: dict[int, list[float]] = {}
        for (i, rank), value in zip(asked, got):
            if rank is None:
                guesses.setdefault(i, []).append(value)
            else:
                open_[i].found[rank] = value
        for i, (low, high) in guesses.items():
            open_[i].guess = (low, high)
        for i, search in list(open_.items()):
            at = (row[f"n{i}"] - 1) * q
            if {math.floor(at), math.ceil(at)} <= search.found.keys():
                lo, hi = search.found[math.floor(at)], search.found[math.ceil(at)]
                out[i] = lo + (hi - lo) * (at - math.floor(at)) if hi != lo else lo
                del open_[i]
    return spark.createDataFrame([(c, out.get(i)) for i, c in enumerate(cols)], "column string, value double")


def top_n(
    df: DataFrame, n: int, score: str, key: str, group: Sequence[str] = (), rank: str | None = None
) -> DataFrame:
    """The n rows with the highest score, ties by key; per group when groups are given.

    The per-group form keeps n rows per input partition before its shuffle.
    """
    if not group and rank is None:
        return df.orderBy(F.desc(score), F.asc(key)).limit(n)
    keyed, keys = _keyed(df, group)
    name = rank or "_rank"
    order = W.partitionBy(*keys).orderBy(F.desc(score), F.asc(key))
    out = keyed.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= n).drop("_g")
    return out if rank else out.drop(name)


def set_overlap(df: DataFrame, models: Sequence[str], n: int, score: str = "probability", key: str = "account_id") -> DataFrame:
    """(model_a, model_b, overlap): shared share of the top-n keys of all model pairs.

    Membership is one row per key with a flag per model; pairs are products of two flags, so no
    pair of rows is ever built.
    """
    top = top_n(df.filter(F.col("model").isin(list(models))), n, score, key, group=["model"])
    flags = top.groupBy(key).agg(
        *[F.max((F.col("model") == m).cast("int")).alias(f"m{i}") for i, m in enumerate(models)]
    )
    pairs = [(i, j) for i in range(len(models)) for j in range(i, len(models))]
    counted = flags.agg(
        *[F.coalesce(F.sum(F.col(f"m{i}") * F.col(f"m{j}")), F.lit(0)).alias(f"p{i}_{j}") for i, j in pairs]
    )
    cells = [
        F.struct(
            F.lit(models[i]).alias("model_a"),
            F.lit(models[j]).alias("model_b"),
            (F.col(f"p{min(i, j)}_{max(i, j)}") / F.lit(float(n))).alias("overlap"),
        )
        for i in range(len(models))
        for j in range(len(models))
    ]
    return counted.select(F.inline(F.array(*cells)))


def running_total_lag(df: DataFrame, order: str, value: str, out: str = "base") -> DataFrame:
    """Total of all earlier rows (a short report table: one row per step)."""
    earlier = W.partitionBy(F.lit(0)).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
