"""Range tables: runs of consecutive numbers of a level's line, joins with them, and positions in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mono import to_mono
from ..staging import staged
from .neighbours import edges

#: Numbers a bucket: windows go over buckets, and ranges meet points in them.
BUCKET = 7**5


def _bucket(c: Column, size: int | None = None) -> Column:
    return F.call_function("div", c, F.lit(size or BUCKET).cast("long"))


def _islands(df: DataFrame, over: list) -> DataFrame:
    """Merge start, end rows that follow one another within the windows' partitions."""
    w = Window.partitionBy(*over).orderBy("start", "end")
    gap = F.coalesce((F.col("start") != F.lag("end").over(w) + 1).cast("int"), F.lit(1))
    df = df.withColumn("gap", gap).withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*over, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("start", "end")


def find_ranges(df: DataFrame, mono: str = "mono") -> DataFrame:
    """start, end of every run of consecutive numbers; both inclusive. A number that comes twice begins a new range; nulls
    count for nothing; an empty table gives none.

    Runs are found bucket by bucket. Only those that touch an end of their bucket can go on in the next, and are put
    together in buckets of buckets; what goes over all of them then is two rows a bucket of the largest kind at most. Each
    round is written to the shared folder, so the table is read once.
    """
    left = df.select(F.col(mono).alias("start"), F.col(mono).alias("end")).dropna()
    size, done = BUCKET, []
    for _ in range(3):
        runs = staged(_islands(left.withColumn("bucket", _bucket(F.col("start"), size)), ["bucket"]), "runs")
        at_end = (F.pmod("start", F.lit(size)) == 0) | (F.pmod("end", F.lit(size)) == size - 1)
        done.append(runs.where(~at_end))
        left, size = runs.where(at_end), size * BUCKET
        if left.isEmpty():
            break
    found = _islands(left, [])
    for runs in done:
        found = found.union(runs)
    return staged(found, "ranges")


def find_distinct_ranges(df: DataFrame, mono: str = "mono") -> DataFrame:
    """The same with repeated numbers counted once."""
    return find_ranges(df.select(mono).distinct(), mono)


def range_offsets(ranges: DataFrame) -> DataFrame:
    """Adds n, the numbers in a range, and offset, those in all ranges before it.

    Sums run within buckets, and over the buckets' sums; only these meet in one place.
    """
    sized = ranges.withColumn("n", F.col("end") - F.col("start") + 1).withColumn("bucket", _bucket(F.col("start"), BUCKET**2))
    before = lambda *over: Window.partitionBy(*over).rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("bucket").agg(F.sum("n").alias("all"))
    bases = sums.select("bucket", F.coalesce(F.sum("all").over(before().orderBy("bucket")), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n").over(before("bucket").orderBy("start", "end")), F.lit(0))
    placed = sized.withColumn("inner", inner).join(bases, "bucket")
    return placed.select(*ranges.columns, "n", (F.col("base") + F.col("inner")).cast("long").alias("offset"))


def expand_ranges(ranges: DataFrame, out: str = "mono") -> DataFrame:
    """A row per number; a range whose end is before its start has none."""
    return ranges.where("end >= start").select(F.explode(F.sequence("start", "end")).alias(out))


def range_join(points: DataFrame, ranges: DataFrame, mono: str = "mono", how: str = "left", prefix: str = "") -> DataFrame:
    """points with the range that holds each number, its columns named with the prefix: an equi-join by bucket, then the bounds.
    A range is sent to each bucket that it touches, so the join shuffles by key and neither side is broadcast or compared with
    all of the other. A null number is in no range; repeated points are each joined, with every range that holds them."""
    low, high = _bucket(F.col("start")), _bucket(F.col("end"))
    held = ranges.where("end >= start").withColumn("__range_bucket", F.explode(F.sequence(low, high)))
    held = held.select("__range_bucket", *[F.col(c).alias(f"{prefix}{c}") for c in ranges.columns])
    keyed = points.withColumn("__bucket", _bucket(F.col(mono)))
    inside = (keyed["__bucket"] == held["__range_bucket"]) & keyed[mono].between(held[f"{prefix}start"], held[f"{prefix}end"])
    return keyed.join(held, inside, how).drop("__bucket", "__range_bucket")


def positions(points: DataFrame, offsets: DataFrame, mono: str = "mono", out: str = "position") -> DataFrame:
    """Adds each number's place in the archive's order, -1 where no range holds it, as for null. A column named ``out`` is
    replaced, any other is left as it is."""
    joined = range_join(points, offsets, mono, prefix="__")
    place = F.coalesce(F.col("__offset") + F.col(mono) - F.col("__start"), F.lit(-1)).cast("long")
    return joined.withColumn(out, place).drop(*[f"__{c}" for c in offsets.columns])


def at_positions(df: DataFrame, offsets: DataFrame, first: int, last: int, mono: str = "mono") -> DataFrame:
    """Rows of an archive at places first up to, not including, last: the numbers there are a few ranges, whose least and
    greatest reach the scan as bounds."""
    stop = F.least(F.lit(last), F.col("offset") + F.col("n")) - F.col("offset") + F.col("start") - 1
    cut = offsets.where((F.col("offset") < last) & (F.col("offset") + F.col("n") > first))
    cut = cut.select((F.col("start") + F.greatest(F.lit(first) - F.col("offset"), F.lit(0))).alias("start"), stop.alias("end"))
    low, high = cut.agg(F.min("start"), F.max("end")).first()
    return range_join(df.where(F.col(mono).between(low, high)), cut, mono, "left_semi")


def halo_amplification(df: DataFrame, offsets: DataFrame, level: int, chunk: int, cell: str = "cell") -> DataFrame:
    """One row: chunks of so many cells; touches, the chunks that tasks of a chunk each read for its own cells and their
    neighbours; amplification, how many times the chunks that is; foreign, pairs of a chunk and another one that it reads; halo,
    neighbours that lie in another chunk. Cells that the archive lacks don't count."""
    part = lambda c: F.call_function("div", F.col(c), F.lit(chunk).cast("long"))
    own = positions(df.select(F.col(cell).alias("cell"), to_mono(F.col(cell), level).alias("mono")), offsets, out="at").where("at >= 0")
    near = edges(own.select("cell", "at")).where("nbr IS NOT NULL").withColumn("mono", to_mono(F.col("nbr"), level))
    near = positions(near, offsets, out="there").where("there >= 0").select(part("at").alias("a"), part("there").alias("b")).where("a <> b")
    foreign = near.groupBy("a", "b").agg(F.count("*").alias("n")).agg(F.count("*").alias("foreign"), F.coalesce(F.sum("n"), F.lit(0)).alias("halo"))
    chunks = offsets.agg(F.ceil(F.sum("n") / chunk).alias("chunks")).first()[0]
    touches = F.col("foreign") + F.lit(chunks)
    return foreign.select(F.lit(chunks).alias("chunks"), touches.alias("touches"), (touches / chunks).alias("amplification"), "foreign", "halo")


def slice_cells(offsets: DataFrame, first: int, last: int, out: str = "mono") -> DataFrame:
    """The numbers at places first up to, not including, last."""
    start = F.greatest(F.lit(first), F.col("offset"))
    stop = F.least(F.lit(last), F.col("offset") + F.col("n"))
    cut = offsets.where((F.col("offset") < last) & (F.col("offset") + F.col("n") > first))
    return cut.select(F.explode(F.sequence(F.col("start") + start - F.col("offset"), F.col("start") + stop - F.col("offset") - 1)).alias(out))


def chunk_touches(df: DataFrame, position: str, chunk: int) -> DataFrame:
    """One row: cells, chunks touched, and cells read if whole chunks are."""
    part = F.call_function("div", F.col(position), F.lit(chunk).cast("long"))
    counted = df.where(F.col(position) >= 0).agg(F.count("*").alias("cells"), F.countDistinct(part).alias("chunks"))
    return counted.withColumn("cells_read", F.col("chunks") * chunk)


def round_robin_position(position: Column, n: int, chunks: int) -> Column:
    """Where a place goes if the n cells are dealt to so many chunks in turn: the layout without order, for comparison."""
    size, rest = n // chunks, n % chunks
    chunk = F.pmod(position, F.lit(chunks))
    return (chunk * size + F.least(chunk, F.lit(rest)) + F.call_function("div", position, F.lit(chunks).cast("long"))).cast("long")
