"""Stratified split and class weights, exact and without ranking whole classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.session import durable, small_side

# Leading hexadecimal digits of the row hash that form a bucket.
BUCKET_DIGITS = 4


def row_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def place_hash(df: DataFrame, key: str, seed: int, columns: Sequence[str] | None = None) -> Column:
    """Order of rows in a split: by key hash, then by a hash of the whole row, or of the ``columns`` given.

    Rows that repeat a key, or have none, are so told apart unless they are equal in all these columns.
    """
    whole = F.lpad(F.hex(F.xxhash64(*[F.col(c) for c in sorted(columns or df.columns)])), 16, "0")
    return F.concat(row_hash(key, seed), whole)


def test_sizes(counts: DataFrame, label: str, fraction: float) -> DataFrame:
    """Test rows per class from ``(label, n)``.

    The whole test set has ``ceil(fraction * n)`` rows. Train rows are shared
    out in proportion, rounded down, and the rest goes to the largest
    remainders; the test share is what is left. Works on one row per class.
    """
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    train_total = total - F.ceil(total * fraction)
    share = "cast(n as decimal(19,0)) * cast(_train as decimal(18,0))"
    sized = (
        counts.withColumn("_total", total)
        .withColumn("_train", train_total)
        .withColumn("_floor", F.expr(f"{share} div _total"))
        .withColumn("_rest", F.expr(f"{share} % cast(_total as decimal(19,0))"))
    )
    missing = F.col("_train") - F.sum("_floor").over(everything)
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("_rest"), label))
    extra = (F.col("_place") <= F.col("_missing")).cast("int")
    return (
        sized.withColumn("_missing", missing)
        .withColumn("_place", place)
        .select(label, "n", (F.col("n") - F.col("_floor") - extra).alias("n_test"))
    )


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    fraction: float = domain.TEST_FRACTION,
    seed: int = domain.SPLIT_SEED,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``is_test``: the rows with the smallest key hash of each class.

    Ranking a class would sort all its rows in one task. Instead, rows are
    counted per class and hash bucket; running sums of these counts name the
    bucket in which the class quota runs out, and only that bucket's rows, one
    in 16^4 of the class, are ranked to find the last hash that is taken. The
    final pass compares hashes and moves no rows. ``columns`` tell rows of one key apart, all of them unless given.
    """
    hashed = df.withColumn("_hash", place_hash(df, key, seed, columns))
    keyed = hashed.select(label, "_hash", F.substring("_hash", 1, BUCKET_DIGITS).alias("_bucket"))
    buckets = durable(keyed.groupBy(label, "_bucket").agg(F.count("*").alias("n")))
    sizes = test_sizes(buckets.groupBy(label).agg(F.sum("n").alias("n")), label, fraction)
    upto = F.sum("n").over(Window.partitionBy(label).orderBy("_bucket"))
    same = [F.col("b." + label).eqNullSafe(F.col("s." + label))]
    edge = (
        buckets.withColumn("_upto", upto).alias("b")
        .join(sizes.alias("s"), same)
        .filter("_upto - b.n < n_test and n_test <= _upto")
        .select(F.col("b." + label).alias("_label"), F.col("_bucket").alias("_edge"), F.expr("n_test - (_upto - b.n)").alias("_take"))
    )
    edge = durable(edge)
    ranked = (
        keyed.join(small_side(edge), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_edge")))
        .groupBy("_label", "_take", "_hash")
        .agg(F.count("*").alias("_same"))
        .withColumn("_upto", F.sum("_same").over(Window.partitionBy("_label").orderBy("_hash")))
        .filter("_upto - _same < _take and _take <= _upto")
        .select("_label", F.col("_hash").alias("_last"), F.expr("_take - (_upto - _same)").alias("_of"), "_same")
    )
    last = durable(ranked)
    joined = hashed.join(small_side(last), F.col(label).eqNullSafe(F.col("_label")), "left")
    shown = [*df.columns, "is_test"]
    sure = joined.withColumn("is_test", F.coalesce(F.col("_hash") <= F.col("_last"), F.lit(False)))
    if last.filter("_of < _same").isEmpty():
        return sure.select(shown)
    # of rows equal in all columns only so many are taken as the quota asks for
    open_ = F.coalesce((F.col("_hash") == F.col("_last")) & (F.col("_of") < F.col("_same")), F.lit(False))
    number = F.row_number().over(Window.partitionBy("_label", "_hash").orderBy("_hash"))
    some = joined.filter(open_).withColumn("is_test", number <= F.col("_of"))
    return sure.filter(~open_).select(shown).unionByName(some.select(shown))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    return counts.withColumn(
        "weight", F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    )


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    weights = durable(class_weights(df, label).select(F.col(label).alias("_label"), F.col("weight").alias(name)))
    return df.join(small_side(weights), F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
