"""Shards cut from a Hilbert curve through several metadata dimensions.

Native expressions only. Each dimension is quantised to ``bits`` bits, the cell's index on
the curve is computed, rows are sorted by it over many partitions, and runs of equal length
become shards: a shard covers a compact region, so that minima and maxima of every dimension
let a reader skip files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BITS = 5


def log_level(value: Column, bits: int = BITS) -> Column:
    """Half-octave level of a number of at least 1: equal ratios lie equally far apart."""
    digits = F.bin(F.greatest(value, F.lit(1)))
    octave, half = F.length(digits) - 1, F.substring(digits, 2, 1) == "1"
    return F.least(octave * 2 + half.cast("int"), F.lit((1 << bits) - 1)).cast("int")


def hash_level(value: Column, bits: int = BITS) -> Column:
    """Level of a category: same for equal values, without a dictionary of them; null is a category."""
    return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit("\x00"))), F.lit(1 << bits)).cast("int")


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Distance along the Hilbert curve of a cell with coordinates 0 to 2**bits - 1.

    The axes are untangled bit plane by bit plane, from the highest, then Gray-decoded and
    interleaved (Skilling 2004). The steps run in one ``aggregate`` over a constant list.
    """
    n = len(dims)
    axes = F.array(*[d.cast("int") for d in dims])
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def step(x: Column, s: Column) -> Column:
        low, mine = s["q"] - 1, F.element_at(x, s["i"] + 1)
        swap = x[0].bitwiseXOR(mine).bitwiseAND(low)
        turned = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        swapped = F.transform(x, lambda v, j: F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(mine.bitwiseAND(s["q"]) != 0, turned).otherwise(swapped)

    def gray_decoded(acc: Column, v: Column) -> Column:
        return F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(F.element_at(acc, -1).bitwiseXOR(v))))

    planes = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
    digits = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def closed(g: Column) -> Column:
        t = F.aggregate(planes, F.lit(0), lambda acc, q: F.when(F.element_at(g, -1).bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
        return F.transform(g, lambda v: v.bitwiseXOR(t))

    def interleaved(c: Column) -> Column:
        return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: acc * 2 + (F.element_at(c, d["i"] + 1).bitwiseAND(d["q"]) != 0).cast("long"))

    untangled = F.aggregate(steps, axes, step) if bits > 1 else axes
    # arrays of one element stand in for let-bindings, so that no step is copied into the next
    gray = F.array(F.aggregate(untangled, F.array().cast("array<int>"), gray_decoded))
    return F.transform(F.transform(gray, closed), interleaved)[0]


def global_order(rows: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """``rows`` with ``_rank``, gapless from 0 in the order of ``keys``, without a single-task sort.

    Ranges are sorted apart; the number of rows in the ranges before (one figure for each
    range) is added to the place within the range. The result is a written table, so a place
    once given stays.
    """
    ranged = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    placed = materialize(ranged, "ordered").withColumn("_part", F.shiftright("_m", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return placed.join(starts, "_part").withColumn("_rank", F.col("_before") + F.col("_m") - F.shiftleft("_part", 33)).drop("_part", "_m", "_before")


def hilbert_shards(rows: DataFrame, dims: list[Column], n_shards: int, ties: list[str], bits: int = BITS, partitions: int | None = None) -> DataFrame:
    """``rows`` with curve (index), shard (0 to n_shards-1) and slot (gapless from 0 within it).

    Shards are consecutive runs of the curve whose row counts differ by at most one. ``ties``
    orders rows of one cell; rows equal in these too are interchangeable. Null in a dimension
    is for the caller's quantiser to place (hash_level has a level for it). With fewer rows
    than shards some shards stay empty; an empty table gives no rows.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = global_order(rows.withColumn("curve", hilbert_index(dims, bits)), ["curve", *ties], partitions)
    total = ranked.count()
    q, r = divmod(total, n_shards)
    cut = r * (q + 1)
    rank = F.col("_rank")
    shard = F.when(rank < cut, F.floor(rank / (q + 1))).otherwise(r + F.floor((rank - cut) / max(q, 1))).cast("int")
    start = F.when(F.col("shard") < r, F.col("shard").cast("long") * (q + 1)).otherwise(cut + (F.col("shard") - r).cast("long") * q)
    return ranked.withColumn("shard", shard).withColumn("slot", rank - start).drop("_rank")


def shard_bounds(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum and maximum of each column in each shard: what a reader prunes files by."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order within each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
