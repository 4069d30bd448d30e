"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; a document of a source with target t
and size s words should be taken t / s times on average, which is a whole
number of copies plus a fraction below one. The fractions are rounded pairwise: of
two documents with fractions, mass, counted in words, moves from one to the other
until one of the two is 0 or 1. The direction is drawn so that every
document keeps its expected number of copies, and the words of the pair stay
the same, so a source misses its target by less than one document.

Rounding is a reduction tree. Rows are numbered within hash buckets of a source
and cut into blocks of ``BLOCK``; a block is folded, one pair after another, and leaves
one fraction, the residual; the residuals of all blocks are the rows of the next
round. Each round divides the rows by ``BLOCK``. No row meets more than a block,
and a source with a third of all rows is spread over as many buckets as its size
asks for. Draws are hashes of the two ids, so reruns agree.

Everything is column expressions; no Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vibralake.llm.texts import unused, word_count
from vibralake.session import small_side, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCK = 256
BUCKET = 8192
SEED = 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: source, source_size, target.

    Sources in code point order, null last, take the weights in turn. A source
    stops at ``cap`` times its size; what it cannot take goes to the others by
    weight. Sorted by cap per weight, the sources that stop are a prefix, so the level
    at which the others stand follows from running sums. The windows here see
    one row for each source, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    every = Window.partitionBy()
    ranked = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    onward = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(onward))
    stops = F.col("most") <= F.col("level") * F.col("weight")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(~stops, F.col("level")), ignorenulls=True).over(whole)  # of the first that does not stop
    per = per.withColumn("level", level)
    target = F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most"))
    return per.select("source", "source_size", target.alias("target"))


def draw(first: Column, second: Column, round_: int) -> Column:
    """A number in [0, 1) that depends on the two documents and the round only."""
    h = F.xxhash64(F.lit(SEED), F.lit(round_), first, second)
    return F.shiftrightunsigned(h, 11) * F.lit(2.0**-53)


def folded(rows: Column, round_: int) -> Column:
    """Fold structs (doc_id, size, base, part) of one block to (rest, done).

    ``rest`` is the one struct whose part may still be a fraction.
    """
    kind = "struct<doc_id:bigint,size:bigint,base:bigint,part:double>"

    def step(state: Column, row: Column) -> Column:
        a, b = state["rest"], row
        up = F.least((1.0 - a["part"]) * a["size"], b["part"] * b["size"])  # words that can go from b to a
        down = F.least(a["part"] * a["size"], (1.0 - b["part"]) * b["size"])  # and from a to b
        gains = draw(a["doc_id"], b["doc_id"], round_) * (up + down) < down
        fills_a = (1.0 - a["part"]) * a["size"] <= b["part"] * b["size"]
        empties_a = a["part"] * a["size"] <= (1.0 - b["part"]) * b["size"]

        def with_part(s: Column, part: Column) -> Column:
            return F.struct(s["doc_id"].alias("doc_id"), s["size"].alias("size"), s["base"].alias("base"), part.alias("part"))

        new_a = F.when(gains, F.when(fills_a, F.lit(1.0)).otherwise(a["part"] + up / a["size"])).otherwise(
            F.when(empties_a, F.lit(0.0)).otherwise(a["part"] - down / a["size"])
        )
        new_b = F.when(gains, F.when(fills_a, b["part"] - up / b["size"]).otherwise(F.lit(0.0))).otherwise(
            F.when(empties_a, b["part"] + down / b["size"]).otherwise(F.lit(1.0))
        )
        a_done = F.when(gains, fills_a).otherwise(empties_a)
        pair = F.array(with_part(a, new_a), with_part(b, new_b))
        kept = F.when(a_done, pair[1]).otherwise(pair[0])
        out = F.when(a_done, pair[0]).otherwise(pair[1])
        return F.struct(kept.alias("rest"), F.concat(state["done"], F.array(out)).alias("done"))

    start = F.struct(rows[0].cast(kind).alias("rest"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), start, step)


def reduce_round(rows: DataFrame, per_source: DataFrame, round_: int) -> DataFrame:
    """One round: rows (source, doc_id, size, base, part) to blocks (source, folded)."""
    spot = F.xxhash64(F.lit(SEED), F.lit(round_), "doc_id", "size")
    placed = rows.join(small_side(per_source), F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.select(*rows.columns, F.pmod(spot, F.col("_buckets")).alias("bucket"), spot.alias("spot"))
    number = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("spot", "doc_id", "size", "part"))
    blocks = placed.withColumn("block", F.floor((number - 1) / BLOCK))
    row = F.struct("spot", "doc_id", "size", "base", "part")
    gathered = blocks.groupBy("source", "bucket", "block").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    bare = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("doc_id", "size", "base", "part")]))
    return gathered.select("source", bare.alias("rows")).select("source", folded(F.col("rows"), round_).alias("folded"))


def buckets(rows: DataFrame) -> DataFrame:
    """Per source, the number of hash buckets that its rows go to."""
    return rows.groupBy(F.col("source").alias("_source")).agg(
        F.greatest(F.ceil(F.count("*") / BUCKET), F.lit(1)).cast("long").alias("_buckets")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``taken`` is ``copies`` times ``size``. Null and empty texts have size 0 and are
    taken as often as the whole part of their source's rate says. A null source is a source of its own. Rows that
    repeat an id are documents of their own.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"))
    goals = written(targets(sizes, weights, share, cap), "targets")
    sizes = written(sizes, "sizes")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(F.lit(0.0))
    whole = F.floor(rate + F.lit(1e-9))
    part = F.greatest(rate - whole, F.lit(0.0))
    goal = goals.select(F.col("source").alias("_source"), whole.alias("base"), F.when(part > 1e-9, part).otherwise(0.0).alias("part"))
    rows = sizes.join(small_side(goal), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sure = (F.col("part") == 0) | (F.col("size") == 0)
    columns = ("source", "doc_id", "size", "base", "part")
    parts = [rows.filter(sure).select("source", "doc_id", "size", F.col("base").alias("copies"))]
    open_, round_ = rows.filter(~sure).select(*columns), 0
    while True:
        counts = written(buckets(open_), "buckets")
        made = written(reduce_round(open_, counts, round_), "round")
        parts.append(made.select("source", F.inline("folded.done")).select("source", "doc_id", "size", (F.col("base") + F.col("part").cast("long")).alias("copies")))
        rest = made.select("source", "folded.rest.*")
        fraction = (F.col("part") > 0) & (F.col("part") < 1)
        parts.append(rest.filter(~fraction).select("source", "doc_id", "size", (F.col("base") + F.col("part").cast("long")).alias("copies")))
        open_, round_ = rest.filter(fraction).select(*columns), round_ + 1
        if open_.groupBy("source").count().filter("count > 1").isEmpty():
            break
    last = draw(F.col("doc_id"), F.lit(-1).cast("long"), round_) < F.col("part")
    parts.append(open_.select("source", "doc_id", "size", (F.col("base") + last.cast("long")).alias("copies")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    goal = goals.withColumnRenamed("source", "_source")
    joined = out.join(small_side(goal), F.col("source").eqNullSafe(F.col("_source")))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def copies(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns.

    Rows that share an id share the copies of the first of them.
    """
    id_, times, number = (unused(docs, name) for name in ("_id", "_times", "_number"))
    taken = mix(docs).groupBy("doc_id").agg(F.max("copies").alias(times)).withColumnRenamed("doc_id", id_)
    rows = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(id_))).filter(F.col(times) > 0)
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(number)).drop(number)
