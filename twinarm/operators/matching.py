"""Greedy caliper matching on the propensity score, distributed.

Subjects first collapse to one row per distinct score and arm. Each group picks its best partner
under one strict order (distance, mixed key, scores); best partners are neighbours in the sorted
scores. A group accepts those that picked it, in its own order, until its subjects are used up or a
nearer partner comes that picked another group. So a score that many subjects share takes all its
partners in one round, and the pairs are those of going through all pairs by that order one after
the other. Chains of ever smaller gaps would take a round per link: where there are many groups, or
rounds go on, the pairs of a range of scores are gone through in that order within a task, as far as no
score outside the range can interfere.
"""

from __future__ import annotations

import heapq
import logging
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinarm.operators.ranking import id_range, sliced_row_number
from twinarm.session import cut, small_side, stored

# Scores are compared as integers in units of 1e-9.
SCORE_UNIT = 1_000_000_000
GROUPS_PER_BUCKET = 200_000
# Groups above which ranges of scores are settled at once, and rounds after which they are in any case.
MANY_GROUPS, ROUNDS = 10_000, 7
MIX_T, MIX_C, MIX_MOD = 31, 17, 1009
CALIPER_SCALES = ("standardized", "propensity score")

log = logging.getLogger(__name__)


def _scored(scored: DataFrame, keys: list[str], caliper: float, scale: str) -> DataFrame:
    """Integer score and caliper per row; the standardized caliper is in units of sd(ps)."""
    if scale not in CALIPER_SCALES:
        raise ValueError(f"caliper scale must be one of {CALIPER_SCALES}")
    rows = scored.withColumn("score", F.round(F.col("ps") * SCORE_UNIT).cast("long"))
    width = F.lit(float(caliper))
    if scale == "standardized":
        spread = scored.groupBy(*keys).agg(
            F.coalesce(F.stddev_samp("ps"), F.lit(0.0)).alias("spread")
        )
        rows = rows.join(F.broadcast(spread), keys)  # a row for each model of the grid
        width = width * F.col("spread")
    return rows.withColumn("width", F.floor(width * SCORE_UNIT).cast("long")).drop("spread")


def _buckets(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Score ranges that hold about equally many distinct scores each, ``bucket`` per group. Their
    number follows the largest model."""
    largest = groups.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    parts = largest // GROUPS_PER_BUCKET
    if parts == 0:
        return groups.withColumn("bucket", F.lit(0))
    shares = [(i + 1) / (parts + 1) for i in range(parts)]
    bounds = small_side(
        groups.groupBy(*keys).agg(
            F.percentile_approx("score", shares, 100 * (parts + 1)).alias("bounds")
        )
    )
    return (
        groups.join(bounds, keys)
        .withColumn("bucket", F.size(F.filter("bounds", lambda b: b < F.col("score"))))
        .drop("bounds")
    )


def _mix(t: Column, c: Column) -> Column:
    return F.pmod(t * MIX_T + c * MIX_C, F.lit(MIX_MOD))


def _edges(state: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest scores of both arms outside each bucket, from one row of extremes per bucket."""
    place = [*keys, "bucket"]
    t_score = F.when(F.col("treatment") == 1, F.col("score"))
    c_score = F.when(F.col("treatment") == 0, F.col("score"))
    edges = state.groupBy(*place).agg(
        F.max(t_score).alias("max_t"),
        F.max(c_score).alias("max_c"),
        F.min(t_score).alias("min_t"),
        F.min(c_score).alias("min_c"),
    )
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    after = Window.partitionBy(*keys).orderBy(F.col("bucket").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return edges.select(
        *place,
        F.max("max_t").over(before).alias("below_t"),
        F.max("max_c").over(before).alias("below_c"),
        F.min("min_t").over(after).alias("above_t"),
        F.min("min_c").over(after).alias("above_c"),
    )


def _in_order(
    score: list[int], arm: list[int], size: list[int], width: int, below: list[int | None], above: list[int | None]
) -> list[tuple[int, int, int]]:
    """Pairs ``(treated score, comparator score, matched)`` among groups of rising scores, by the strict order, that do
    not depend on groups outside; ``below`` and ``above`` are the nearest of those by arm.

    The first pair in the order always stands side by side among what is left. A group that a group outside may take
    first is set aside, and counts as outside from then on.
    """
    n = len(score)
    before, behind, size = [i - 1 for i in range(n)], [i + 1 for i in range(n)], list(size)
    outside = {-1: list(below), n: list(above)}
    gone = [False] * n
    waiting: list[tuple[int, int, int, int, int, int]] = []
    found: list[tuple[int, int, int]] = []

    def add(i: int, j: int) -> None:
        """The pair of neighbours; -1 and n stand for what is outside."""
        if i < 0 and j >= n:
            return
        one = j if i < 0 else i
        if i < 0 or j >= n:
            there = outside[-1 if i < 0 else n][1 - arm[one]]
        else:
            there = score[j] if arm[i] != arm[j] else None
        if there is not None and abs(there - score[one]) <= width:
            t, c = (score[one], there) if arm[one] == 1 else (there, score[one])
            heapq.heappush(waiting, (abs(t - c), (t * MIX_T + c * MIX_C) % MIX_MOD, t, c, i, j))

    def leave(i: int) -> None:
        gone[i] = True
        if before[i] >= 0:
            behind[before[i]] = behind[i]
        if behind[i] < n:
            before[behind[i]] = before[i]

    for i in range(n + 1):
        add(i - 1, i)
    while waiting:
        _, _, t, c, i, j = heapq.heappop(waiting)
        if i < 0 or j >= n:
            inner, side = (j, -1) if i < 0 else (i, n)
            if gone[inner] or (before[inner] >= 0 if i < 0 else behind[inner] < n):
                continue
            leave(inner)
            outside[side][arm[inner]] = score[inner]
            add(*((-1, behind[inner]) if i < 0 else (before[inner], n)))
            continue
        if gone[i] or gone[j] or behind[i] != j:
            continue
        taken = min(size[i], size[j])
        found.append((t, c, taken))
        for k in (i, j):
            size[k] -= taken
            if not size[k]:
                leave(k)
        add(before[i] if gone[i] else i, behind[j] if gone[j] else j)
    return found


def _settle(state: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of score groups as ``_round``, as far as they can be told within each bucket."""
    place = [*keys, "bucket"]
    known = state.join(_edges(state, keys), place)
    sides = ("below_c", "below_t", "above_c", "above_t")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("score")
        score, arm, size = (table.column(c).to_pylist() for c in ("score", "treatment", "size"))
        below_c, below_t, above_c, above_t = (table.column(c)[0].as_py() for c in sides)
        found = _in_order(score, arm, size, table.column("width")[0].as_py(), [below_c, below_t], [above_c, above_t])
        named = [table.column(k).take(pa.array([0] * len(found), pa.int64())) for k in keys]
        told = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
        return pa.Table.from_arrays([*named, *told], names=[*keys, "t_score", "c_score", "matched"])

    schema = ", ".join(f"`{c}` {t}" for c, t in state.select(*keys).dtypes) + ", t_score long, c_score long, matched long"
    return known.groupBy(*place).applyInArrow(run, schema)


def _round(state: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of score groups matched now, ``(keys, t_score, c_score, matched)``."""
    place = [*keys, "bucket"]
    upward = Window.partitionBy(*place).orderBy("score").rowsBetween(
        Window.unboundedPreceding, -1
    )
    downward = Window.partitionBy(*place).orderBy(F.col("score").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    t_score = F.when(F.col("treatment") == 1, F.col("score"))
    c_score = F.when(F.col("treatment") == 0, F.col("score"))
    edges = _edges(state, keys)
    near = (
        state.withColumn("low_t", F.last(t_score, True).over(upward))
        .withColumn("low_c", F.last(c_score, True).over(upward))
        .withColumn("high_t", F.last(t_score, True).over(downward))
        .withColumn("high_c", F.last(c_score, True).over(downward))
        .join(edges, place)
    )
    treated = F.col("treatment") == 1
    low = F.when(treated, F.coalesce("low_c", "below_c")).otherwise(
        F.coalesce("low_t", "below_t")
    )
    high = F.when(treated, F.coalesce("high_c", "above_c")).otherwise(
        F.coalesce("high_t", "above_t")
    )

    def pair(other):
        t = F.when(treated, F.col("score")).otherwise(other)
        c = F.when(treated, other).otherwise(F.col("score"))
        distance = F.abs(t - c)
        mix = _mix(t, c)
        return F.when(
            distance <= F.col("width"),
            F.struct(
                distance.alias("distance"),
                mix.alias("mix"),
                t.alias("t_score"),
                c.alias("c_score"),
            ),
        )

    picked = near.withColumn("low_seen", low).withColumn("high_seen", high).withColumn(
        "best", F.least(pair(F.col("low_seen")), pair(F.col("high_seen")))
    )
    other = F.when(treated, F.col("best.c_score")).otherwise(F.col("best.t_score"))
    picked = picked.withColumn("other", other)
    # The nearest partner on each side that picked another group: one that looks the other way, or
    # the first one behind the next group of the own arm. What lies outside the bucket counts as such.
    upwards = F.coalesce(F.col("other") > F.col("score"), F.lit(False))
    downwards = F.coalesce(F.col("other") < F.col("score"), F.lit(False))

    def elsewhere(window, towards, seen, outside_t, outside_c, nearer):
        def of(arm: int, outside: str):
            away = F.last(F.when((F.col("treatment") == arm) & ~towards, F.col("score")), True)
            behind = F.last(F.when(F.col("treatment") == 1 - arm, F.col(seen)), True)
            return nearer(away.over(window), F.coalesce(behind.over(window), F.col(outside)))

        return F.when(treated, of(0, outside_c)).otherwise(of(1, outside_t))

    picked = picked.withColumn(
        "stop_low", elsewhere(upward, upwards, "low_seen", "below_t", "below_c", F.greatest)
    ).withColumn(
        "stop_high", elsewhere(downward, downwards, "high_seen", "above_t", "above_c", F.least)
    )
    picked = picked.withColumn(
        "stop", F.least(pair(F.col("stop_low")), pair(F.col("stop_high")))
    )
    # Each group once as host, and once under the group it picked.
    none = F.lit(None)
    hosts = picked.select(
        *keys,
        F.col("treatment").alias("arm"),
        F.col("score").alias("host"),
        F.col("size").alias("room"),
        "stop",
        F.col("best").alias("own"),
        none.cast(picked.schema["best"].dataType).alias("best"),
        none.cast("long").alias("size"),
    )
    suitors = picked.filter("best is not null").select(
        *keys,
        (1 - F.col("treatment")).alias("arm"),
        F.col("other").alias("host"),
        none.cast("long").alias("room"),
        none.cast(picked.schema["stop"].dataType).alias("stop"),
        none.cast(picked.schema["best"].dataType).alias("own"),
        "best",
        "size",
    )
    at_host = Window.partitionBy(*keys, "arm", "host").orderBy("best")  # the host itself comes first
    before_me = at_host.rowsBetween(Window.unboundedPreceding, -1)
    met = (
        hosts.unionByName(suitors)
        .withColumn("room", F.first("room").over(at_host))
        .withColumn("stop", F.first("stop").over(at_host))
        .withColumn("own", F.first("own").over(at_host))
        .withColumn("used", F.coalesce(F.sum("size").over(before_me), F.lit(0)))
        .filter("best is not null")
    )
    # A pair that picked each other is the host's first, wherever the partner lies.
    mutual = F.col("best") == F.col("own")
    open_to = F.col("stop").isNull() | (F.col("best") < F.col("stop")) | mutual
    take = F.when(open_to, F.least(F.col("size"), F.col("room") - F.col("used"))).otherwise(0)
    # Two groups that picked each other meet twice and take the same.
    return (
        met.withColumn("matched", take)
        .filter("matched > 0")
        .groupBy(*keys, F.col("best.t_score").alias("t_score"), F.col("best.c_score").alias("c_score"))
        .agg(F.max("matched").alias("matched"))
    )


def match_groups(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Matched score groups ``(keys, round, t_score, c_score, matched)``.

    ``groups`` has one row per keys, score and arm with its ``size`` and the caliper ``width``.
    Rounds go on until no pair is left; each round cuts the lineage once. With one range of scores a model, a settling
    one is the last.
    """
    sides = Window.partitionBy(*keys, "score")
    t_size = F.sum(F.when(F.col("treatment") == 1, F.col("size"))).over(sides)
    c_size = F.sum(F.when(F.col("treatment") == 0, F.col("size"))).over(sides)
    tied = stored(
        _buckets(
            groups.withColumn("same", F.coalesce(F.least(t_size, c_size), F.lit(0)))
            .withColumn("same", F.when(t_size.isNull() | c_size.isNull(), 0).otherwise(F.col("same"))),
            keys,
        )
    )
    columns = [*keys, "round", "t_score", "c_score", "matched"]
    found = [
        tied.filter("same > 0 and treatment = 1").select(
            *keys,
            F.lit(0).alias("round"),
            F.col("score").alias("t_score"),
            F.col("score").alias("c_score"),
            F.col("same").alias("matched"),
        )
    ]
    state = tied.withColumn("size", F.col("size") - F.col("same")).filter("size > 0").drop("same")
    number, ranges = 0, tied.agg(F.max("bucket")).first()[0] or 0
    many = state.limit(MANY_GROUPS + 1).count() > MANY_GROUPS
    settle = many
    while True:
        number += 1
        pairs = cut((_settle if settle else _round)(state, keys))
        if pairs.isEmpty() and not (settle and ranges):
            log.info("matching finished after %d rounds", number)
            break
        found.append(pairs.withColumn("round", F.lit(number)).select(*columns))
        if settle and not ranges:
            log.info("matching finished after %d rounds", number)
            break
        # What crosses the border of two ranges takes rounds.
        settle = not settle and (many or number >= ROUNDS)
        taken = cut(
            pairs.select(
                *keys,
                F.explode(
                    F.array(
                        F.struct(F.lit(1).alias("treatment"), F.col("t_score").alias("score")),
                        F.struct(F.lit(0).alias("treatment"), F.col("c_score").alias("score")),
                    )
                ).alias("g"),
                "matched",
            )
            .groupBy(*keys, "g.treatment", "g.score")
            .agg(F.sum("matched").alias("matched"))
        )
        state = stored(
            state.join(taken, [*keys, "treatment", "score"], "left")
            .withColumn("size", F.col("size") - F.coalesce("matched", F.lit(0)))
            .filter("size > 0")
            .drop("matched")
        )
    return reduce(DataFrame.unionByName, found).select(*columns)


def _positions(pairs: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Where each matched pair begins within its score group: rounds first, then the strict order."""
    t, c = F.col("t_score"), F.col("c_score")
    order = Window.partitionBy(*keys, side).orderBy("round", F.abs(t - c), _mix(t, c), t, c)
    return F.sum("matched").over(order) - F.col("matched")


def match(
    scored: DataFrame,
    keys: list[str],
    caliper: float = 0.25,
    scale: str = "standardized",
    max_ratio: int = 1,
    strata: tuple[str, ...] = (),
) -> DataFrame:
    """Matched rows with ``stratum_id``; each row is used at most once.

    ``keys`` separate the models, ``strata`` are further columns that must agree. Within a score
    group rows pair up by subject and start date. With ``max_ratio`` above 1 every further pass
    offers the comparators left over to the treated rows matched in the pass before.
    """
    rows = _scored(scored, keys, caliper, scale)
    keys = [*keys, *strata]
    rows = cut(
        sliced_row_number(
            rows,
            [*keys, "treatment", "score"],
            [id_range("subject_id")],
            [F.col("subject_id"), F.col("cohort_start_date")],
            "place",
        ).withColumn("place", F.col("place") - 1)
    )
    groups = rows.groupBy(*keys, "treatment", "score").agg(
        F.count("*").alias("size"), F.first("width").alias("width")
    )
    used = groups.select(*keys, "treatment", "score", F.lit(0).cast("long").alias("from_place"))
    spans = []
    for _ in range(max_ratio):
        pairs = match_groups(groups, keys)  # its parts are cut already
        if pairs.isEmpty():
            break
        placed = pairs.withColumn("t_from", _positions(pairs, keys, "t_score")).withColumn(
            "c_from", _positions(pairs, keys, "c_score")
        )
        shift = used.filter("treatment = 0").select(
            *keys, F.col("score").alias("c_score"), "from_place"
        )
        placed = (
            placed.join(shift, [*keys, "c_score"], "left")
            .withColumn("c_from", F.col("c_from") + F.coalesce("from_place", F.lit(0)))
            .drop("from_place")
        )
        if max_ratio > 1:
            placed = cut(placed)
        spans.append(placed)
        if max_ratio > 1:
            taken_t = placed.groupBy(*keys, F.col("t_score").alias("score")).agg(
                F.sum("matched").alias("taken")
            )
            taken_c = placed.groupBy(*keys, F.col("c_score").alias("score")).agg(
                F.sum("matched").alias("taken")
            )
            treated = (
                groups.filter("treatment = 1")
                .join(taken_t, [*keys, "score"])
                .withColumn("size", F.col("taken"))
                .drop("taken")
            )
            left = (
                groups.filter("treatment = 0")
                .join(taken_c, [*keys, "score"], "left")
                .withColumn("size", F.col("size") - F.coalesce("taken", F.lit(0)))
                .filter("size > 0")
                .drop("taken")
            )
            used = cut(
                used.join(
                    taken_c.withColumn("treatment", F.lit(0)), [*keys, "treatment", "score"], "left"
                )
                .withColumn("from_place", F.col("from_place") + F.coalesce("taken", F.lit(0)))
                .drop("taken")
            )
            groups = stored(treated.unionByName(left))
    if not spans:
        return rows.filter(F.lit(False)).withColumn("stratum_id", F.lit("")).drop(
            "score", "width", "place"
        )
    # The treated row of a stratum is matched in the first pass; later passes add comparators.
    comparators = reduce(DataFrame.unionByName, spans).select(
        *keys,
        F.lit(0).alias("treatment"),
        F.col("c_score").alias("score"),
        F.col("c_from").alias("from_place"),
        "matched",
        "t_score",
        F.col("t_from").alias("t_place"),
    )
    treated = spans[0].select(
        *keys,
        F.lit(1).alias("treatment"),
        F.col("t_score").alias("score"),
        F.col("t_from").alias("from_place"),
        "matched",
        "t_score",
        F.col("t_from").alias("t_place"),
    )
    joined = _carry(rows, treated.unionByName(comparators), [*keys, "treatment", "score"])
    stratum = F.concat_ws(
        "-", F.col("t_score"), F.col("t_place") + F.col("place") - F.col("from_place")
    )
    return joined.withColumn("stratum_id", stratum).drop(
        "score", "width", "place", "from_place", "matched", "t_score", "t_place"
    )


PLACES = 65_536


def _carry(rows: DataFrame, spans: DataFrame, group: list[str]) -> DataFrame:
    """Rows with the span of places they fall into, by merging both in order of place.

    Groups are cut into ranges of places, and a span goes into each range that it covers, so neither a
    hot score nor its many spans meet in one window.
    """
    last = F.col("from_place") + F.col("matched") - 1
    parts = F.sequence(F.floor(F.col("from_place") / PLACES), F.floor(last / PLACES))
    carried = ["from_place", "matched", "t_score", "t_place"]
    starts = spans.withColumn("part", F.explode(parts)).select(
        *group,
        "part",
        F.greatest(F.col("from_place"), F.col("part") * PLACES).alias("at"),
        F.lit(0).alias("kind"),
        F.struct(*carried).alias("span"),
        F.lit(None).cast(StructType([f for f in rows.schema if f.name not in group])).alias("row"),
    )
    places = rows.select(
        *group,
        F.floor(F.col("place") / PLACES).alias("part"),
        F.col("place").alias("at"),
        F.lit(1).alias("kind"),
        F.lit(None).cast(starts.schema["span"].dataType).alias("span"),
        F.struct(*[c for c in rows.columns if c not in group]).alias("row"),
    )
    order = Window.partitionBy(*group, "part").orderBy("at", "kind")
    met = starts.unionByName(places).withColumn("span", F.last("span", True).over(order))
    return (
        met.filter("kind = 1 and at < span.from_place + span.matched")
        .select(*group, "row.*", "span.*")
        .select(*rows.columns, *carried)
    )
