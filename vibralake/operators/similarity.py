"""Most similar historical readings by cosine over scaled features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.functions import numeric
from vibralake.operators import dashboard, scaling, topk
from vibralake.session import PACKED, discard, durable, fits, small_side, written

# Reference rows that divide a large history into cells: as many as the root of its rows, within these.
PIVOTS, MOST_PIVOTS = 256, 4096
# Cells that hold rows a distance cannot place.
ZERO_ITEMS, ZERO_QUERIES = -1, -2
# Items and queries of a piece in which whole cells lie together, at most (a last cell may go over), and tasks a core that pieces are made for.
PIECE_ROWS, TASKS = 32_768, 3
# Angles that a task holds at once while it places rows among the pivots.
BLOCK_ANGLES = 1_000_000
# Allowance for rounding, in score and in angle.
SLACK = 1e-6


def unit_rows(values: np.ndarray, scale: scaling.Scale) -> np.ndarray:
    """Standardised rows of length one; a zero row stays zero."""
    rows = np.where(np.isfinite(values), values, 0.0)
    rows = (rows - np.asarray(scale.mean)) / np.asarray(scale.scale)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _scorer(features: str, scale: scaling.Scale):
    def prepare(queries: pa.Table):
        turned = unit_rows(topk.matrix(queries[features]), scale).T
        return lambda items: unit_rows(topk.matrix(items[features]), scale) @ turned

    return prepare


def _unit_scorer(features: str):
    def prepare(queries: pa.Table):
        turned = topk.matrix(queries[features]).T
        return lambda items: topk.matrix(items[features]) @ turned

    return prepare


def nearest(
    events: DataFrame,
    history: DataFrame,
    k: int = domain.SIMILAR_TOP_K,
    scale: scaling.Scale | None = None,
    features: str = "features",
    key: str = "id",
    strict: bool = True,
    few: int = topk.FEW_QUERIES,
) -> DataFrame:
    """``(query_id, item_id, score, rank)``: the k nearest rows of each event.

    The scale is fitted on the history unless given. An event that is in the
    history finds itself. Rows without a vector, or with nulls in it, take no part. With ``strict`` a history of fewer than k rows is an
    error, as it is for a single event.
    """
    usable = F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull())
    events, history = events.filter(usable), history.filter(usable)
    queries = events.select(F.col(key), F.col(features).cast("array<double>").alias(features))
    items = history.select(F.col(key), F.col(features).cast("array<double>").alias(features))
    if strict and items.limit(k).count() < k:
        raise ValueError(f"history holds fewer than k={k} rows")
    if scale is None:
        scale = scaling.fit_array(history, features)
    if fits(queries, few):
        return topk.rank(topk.scan(queries, items, k, _scorer(features, scale), key, key), k)
    return _nearest_by_cells(queries, items, k, scale, features, key)


def _lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as a column of arrays, without a Python object per number."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def by_vector(queries: DataFrame, items: DataFrame, k: int, group: str, vector: str = "vector", query_id: str = "query_id", item_id: str = "item_id") -> DataFrame:
    """``(query_id, item_id, score, rank)``: best ``k`` items of the query's group by the cosine of supplied vectors.

    Groups are the cells of a grid, a large one in several pieces, so a query
    meets items of its group only. Rows without a group or a whole vector take no part.
    """
    usable = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()) & F.col(group).isNotNull()

    def plain(df: DataFrame, key: str) -> DataFrame:
        return df.filter(usable).select(key, F.col(vector).cast("array<double>").alias(vector), F.col(group).alias("cell"))

    asked, stored = plain(queries, query_id), plain(items, item_id)
    counts = [df.groupBy("cell").agg(F.count("*").alias("n")) for df in (asked, stored)]
    pieces = durable(topk.piece_plan(*counts, "cell"))

    def unit(rows: np.ndarray) -> np.ndarray:
        return unit_rows(rows, scaling.Scale([0.0] * rows.shape[1], [1.0] * rows.shape[1]))

    def prepare(held: pa.Table):
        turned = unit(topk.matrix(held[vector])).T
        return lambda found: unit(topk.matrix(found[vector])) @ turned

    return topk.rank(topk.grid(asked, stored, k, prepare, query_id, item_id, "cell", pieces), k)


def _blocks(batches: Iterator[pa.RecordBatch], angles: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``angles`` numbers a row stay within ``BLOCK_ANGLES``: pivots grow with the items, what a task holds does not."""
    step = max(1, BLOCK_ANGLES // max(angles, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _side_by_side(rows: np.ndarray, most: int = 8) -> np.ndarray:
    """An order in which near rows follow each other: halves along the widest direction, and so on within each half."""
    out, waiting = [], [np.arange(len(rows))]
    while waiting:
        own = waiting.pop()
        if len(own) <= most:
            out.append(own)
            continue
        centred = rows[own] - rows[own].mean(axis=0)
        widest = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        own = own[np.argsort(centred @ widest, kind="stable")]
        waiting += [own[len(own) // 2 :], own[: len(own) // 2]]
    return np.concatenate(out)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _nearest_by_cells(queries, items, k, scale, features, key) -> DataFrame:
    """Exact search that skips cells which cannot hold a neighbour.

    Every item belongs to the cell of its nearest pivot, and a cell knows the
    widest angle of its items. An event first meets the cells around it, which
    gives an upper bound for its k-th angle; by the triangle inequality on
    angles it then needs only cells that reach inside this bound. For that cells lie together in pieces: an event
    goes once to each piece that has a cell it needs, and meets these cells there. Cells whose pivot is farther from the event than the nearest
    pivot by more than twice the bound are ruled out too: a row within the bound would lie nearer to that one. So events and items travel once per piece and not
    once per cell, and pieces grow with the items up to a bound. Pivots are numbered so that near cells lie in one piece. What is
    written on the way is deleted when the neighbours are written.
    """
    spark = queries.sparkSession
    id_type = items.schema[key].dataType.simpleString()
    q_type = queries.schema[key].dataType.simpleString()
    wanted = min(MOST_PIVOTS, max(PIVOTS, math.isqrt(items.count())))
    chosen = items.orderBy(F.xxhash64(key), key).limit(wanted).select(features).toArrow()
    pivots = unit_rows(topk.matrix(chosen[features]), scale)
    pivots = pivots[np.linalg.norm(pivots, axis=1) > 0]
    pivots = pivots[_side_by_side(pivots)]

    def place(batches):
        for batch in _blocks(batches, len(pivots)):
            rows = unit_rows(topk.matrix(batch.column(features)), scale)
            if len(pivots):
                near = rows @ pivots.T
                cell = near.argmax(axis=1).astype(np.int32)
                reach = np.arccos(np.clip(near[np.arange(len(rows)), cell], -1.0, 1.0))
            else:
                cell, reach = np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows))
            zero = np.linalg.norm(rows, axis=1) == 0
            cell[zero] = ZERO_ITEMS
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), _lists(rows), pa.array(cell), pa.array(reach)],
                names=[key, features, "cell", "reach"],
            )

    placed = written(items.mapInArrow(place, f"{key} {id_type}, {features} array<double>, cell int, reach double"), "placed", **PACKED)
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).orderBy("cell").toPandas()
    zero_items = bool((cells["cell"] == ZERO_ITEMS).any())
    cells = cells[cells["cell"] >= 0]
    numbers, sizes, radii = cells["cell"].to_numpy(), cells["n"].to_numpy(), cells["reach"].to_numpy()

    # Zero rows score 0 against everything, so only the k lowest ids can matter;
    # a zero event scores 0 with every row, so it needs the k lowest ids overall.
    lowest_zero = placed.filter(F.col("cell") == ZERO_ITEMS).orderBy(key).limit(k)
    lowest_any = placed.orderBy(key).limit(k).withColumn("cell", F.lit(ZERO_QUERIES))
    stored = placed.filter(F.col("cell") >= 0).unionByName(lowest_zero).unionByName(lowest_any).drop("reach")
    item_counts = durable(stored.groupBy("cell").agg(F.count("*").alias("n")))

    def visits(batches):
        for batch in _blocks(batches, len(numbers)):
            rows = unit_rows(topk.matrix(batch.column(features)), scale)
            zero = np.linalg.norm(rows, axis=1) == 0
            cells = np.append(numbers, [ZERO_ITEMS, ZERO_QUERIES]).astype(np.int32)
            mask = np.zeros((len(rows), len(cells)), bool)
            mask[:, -2] = True
            if len(numbers):
                score = rows @ pivots[numbers].T
                best = score.argmax(axis=1)
                mask[np.arange(len(rows)), best] = True
                few = np.flatnonzero(sizes[best] < k)
                near = np.argsort(-score[few], axis=1, kind="stable")
                more = np.zeros(near.shape, bool)
                np.put_along_axis(more, near, np.cumsum(sizes[near], axis=1) - sizes[near] < k, axis=1)
                mask[few, :-2] |= more
            yield visited(batch, rows, zero, mask, cells, [])

    def visited(batch, rows, zero, mask, places, more):
        """The rows with the places that each goes to; a zero row only to the last one."""
        mask[zero] = False
        mask[zero, -1] = True
        offsets = np.append(0, np.cumsum(mask.sum(axis=1))).astype(np.int32)
        chosen = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places[np.nonzero(mask)[1]]))
        return pa.RecordBatch.from_arrays([batch.column(key), _lists(rows), *[batch.column(c) for c in more], chosen], names=[key, features, *more, "places"])

    around = written(queries.mapInArrow(visits, f"{key} {q_type}, {features} array<double>, places array<int>"), "around", **PACKED)
    asked = around.select(key, features, F.explode("places").alias("cell"))
    first = durable(topk.piece_plan(asked.groupBy("cell").agg(F.count("*").alias("n")), item_counts, "cell"))
    near = topk.rank(topk.grid(asked, stored, k, _unit_scorer(features), key, key, "cell", first), k)
    # With fewer than k rows so far nothing is ruled out: there is no score to reach.
    worst = near.groupBy(F.col("query_id").alias(key)).agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
    bounded = around.drop("places").join(worst, key, "left")

    tasks = TASKS * spark.sparkContext.defaultParallelism
    side = max(-(-int(sizes.sum()) // PIECE_ROWS), math.isqrt(tasks) + 1)
    begins, parts = _pieces(sizes, side)
    n = int((begins + parts).max()) if len(sizes) else 0
    place_of = np.full(len(pivots) + 1, -1)
    place_of[numbers] = np.arange(len(numbers))

    def bounds(bar: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score to reach and widest angle."""
        bar = np.nan_to_num(bar.to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
        return bar, np.arccos(np.clip(bar - SLACK, -1.0, 1.0))

    def reached(rows: np.ndarray, bound: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether a cell can hold a row within the bound: its items lie within its radius, and nearer to its pivot than to any other one."""
        angle, bound = _angles(rows, pivots[numbers[cells]]), bound[:, None] + SLACK
        return (angle - radii[cells] <= bound) & (angle - angle.min(axis=1, keepdims=True) <= 2 * bound)

    def laid(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            piece, own = cell.copy(), np.flatnonzero(cell >= 0)
            at = place_of[cell[own]]
            piece[own] = begins[at] + np.arange(len(own)) % parts[at]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(features), batch.column("cell"), pa.array(piece, pa.int32())], names=[key, features, "cell", "piece"])

    def needed(batches):
        for batch in _blocks(batches, len(numbers)):
            rows = topk.matrix(batch.column(features))
            zero = np.linalg.norm(rows, axis=1) == 0
            mask = np.ones((len(rows), n + 2), bool)
            if n:
                hit = reached(rows, bounds(batch.column("bar"))[1], np.arange(len(numbers)))
                mask[:, :n] = False
                for c in range(len(numbers)):
                    mask[:, begins[c] : begins[c] + parts[c]] |= hit[:, c : c + 1]
            mask[:, -2:] = [zero_items, False]
            places = np.append(np.arange(n), [ZERO_ITEMS, ZERO_QUERIES]).astype(np.int32)
            yield visited(batch, rows, zero, mask, places, ["bar"])

    def meet(held: pa.Table, found: pa.Table, schema: pa.Schema) -> list[pa.RecordBatch]:
        if not held.num_rows or not found.num_rows:
            return []
        cell = found["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        items, ids, cell = topk.matrix(found[features])[order], topk._array(found[key])[order], cell[order]
        starts = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
        runs = list(zip(cell[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True))
        here = np.array([place_of[c] for c, _, _ in runs if c >= 0], int)
        out = []
        for at in range(0, held.num_rows, topk.QUERIES_PER_PIECE):
            part = held.slice(at, topk.QUERIES_PER_PIECE).combine_chunks()
            rows, (bar, bound) = topk.matrix(part[features]), bounds(part["bar"].combine_chunks())
            best = topk.Best(len(rows), k)
            best.bar = bar
            hit = reached(rows, bound, here) if len(here) else None
            for c, a, b in runs:
                asked = np.flatnonzero(hit[:, np.searchsorted(here, place_of[c])]) if c >= 0 else np.arange(len(rows))
                step = topk.block_rows(len(asked))
                for low in range(a, b if len(asked) else a, step):
                    high = min(b, low + step)
                    best.offer_to(asked, ids[low:high], items[low:high] @ rows[asked].T)
            out.append(topk._frame(best, topk._array(part[key]), schema))
        return out

    by_piece = stored.mapInArrow(laid, f"{key} {id_type}, {features} array<double>, cell int, piece int")
    beyond = written(bounded.mapInArrow(needed, f"{key} {q_type}, {features} array<double>, bar double, places array<int>"), "beyond", **PACKED)
    discard(around)
    asked = beyond.select(key, features, "bar", F.explode("places").alias("piece"))
    # each piece of queries gets items of its own, so there are no more of them than the cores ask for
    per = PIECE_ROWS if n >= tasks else max(topk.QUERIES_PER_PIECE, min(PIECE_ROWS, -(-beyond.count() // side)))
    counts = asked.groupBy("piece").agg(F.ceil(F.count("*") / per).cast("int").alias("query_pieces"), F.lit(1).alias("item_pieces"))
    met = topk.grid(asked, by_piece, k, _unit_scorer(features), key, key, "piece", durable(counts), meet=meet)
    found = written(topk.rank(met, k), "nearest", **PACKED)
    discard(placed, beyond)
    return found


def _pieces(sizes: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """First piece and number of pieces of each cell: small cells lie together, a large one is dealt out."""
    most = max(1, -(-int(sizes.sum()) // side))
    parts = -(-sizes // most)
    small = parts == 1
    begins = np.zeros(len(sizes), np.int64)
    held = np.where(small, sizes, 0)
    begins[small] = ((np.cumsum(held) - held) // most)[small]
    first = int(begins.max()) + 1 if len(sizes) else 0
    begins[~small] = first + (np.cumsum(parts[~small]) - parts[~small])
    return begins, parts.astype(np.int64)


def with_rows(found: DataFrame, history: DataFrame, key: str = "id") -> DataFrame:
    """Neighbours with their history columns and the similarity in percent.

    The neighbours are few next to the history. They are written out and
    counted first, so that a small set goes to the history, not the reverse.
    """
    found = written(found, "neighbours", **PACKED)
    score = F.round(numeric.clamp(F.col("score") * 100.0, 0.0, 100.0), 2)
    shown = history.select(
        F.col(key).alias("item_id"), "created_at", "fault", "fault_category", "rpm", "temperature_c",
        "z_rms_velocity_mm_s", "x_rms_velocity_mm_s",
    )
    return shown.join(small_side(found.withColumn("similarity_score", score)), "item_id")


def _matches(n: int | None) -> Column:
    """Neighbours of one event, best first. There are k of them at most."""
    entry = F.struct(
        "rank", F.col("item_id").alias("id"), "created_at", "fault", "fault_category", "similarity_score", "rpm",
        "temperature_c", "z_rms_velocity_mm_s", "x_rms_velocity_mm_s",
    )
    matches = F.array_sort(F.collect_list(entry))
    return (matches if n is None else F.slice(matches, 1, n)).alias("top_matches")


def _context() -> list[Column]:
    return [
        F.count("*").cast("int").alias("similar_count"),
        F.round(F.avg("rpm"), 1).alias("avg_rpm"),
        F.round(F.min("rpm"), 1).alias("min_rpm"),
        F.round(F.max("rpm"), 1).alias("max_rpm"),
        F.round(F.avg("temperature_c"), 2).alias("avg_temp_c"),
        F.round(F.min("temperature_c"), 2).alias("min_temp_c"),
        F.round(F.max("temperature_c"), 2).alias("max_temp_c"),
        F.round(F.avg("z_rms_velocity_mm_s"), 3).alias("avg_z_rms_velocity"),
        F.round(F.avg("x_rms_velocity_mm_s"), 3).alias("avg_x_rms_velocity"),
        F.mode("fault", deterministic=True).alias("primary_historical_fault"),
        F.min_by("fault_category", "rank").alias("match_category"),
    ]


def match_list(neighbours: DataFrame, n: int | None = None) -> DataFrame:
    """Per event the array of its neighbours; ``n`` shows fewer."""
    return neighbours.groupBy("query_id").agg(_matches(n))


def operational_context(neighbours: DataFrame) -> DataFrame:
    """Averages, ranges and the most frequent raw label of each event's neighbours."""
    return neighbours.groupBy("query_id").agg(*_context())


def category_totals(context: DataFrame, history: DataFrame, histogram: bool = False) -> DataFrame:
    """Add the recurrence of the category of each event's best match.

    The history is read once for its daily counts; totals have one row per
    category, so events are not moved to meet them.
    """
    daily = durable(dashboard.daily_counts(history))
    totals = dashboard.recurrence(daily).drop("active_days").withColumnsRenamed(
        {"fault_category": "match_category", "total_occurrences": "total_historical_occurrences"}
    )
    out = context.join(small_side(totals), "match_category", "left")
    if histogram:
        dates = dashboard.date_histogram(daily).withColumnRenamed("fault_category", "match_category")
        out = out.join(small_side(dates), "match_category", "left")
    return out


def similar_events(events: DataFrame, history: DataFrame, k: int = domain.SIMILAR_TOP_K, **options) -> DataFrame:
    """The whole answer per event: count, matches, context, recurrence, days."""
    neighbours = with_rows(nearest(events, history, k, **options), history)
    answered = neighbours.groupBy("query_id").agg(*_context(), _matches(None))
    return category_totals(answered, history, histogram=True)
