"""Correlated criteria and criteria groups around index events."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinarm.operators.events import domain_events, in_observation
from twinarm.sources.cdm import Cdm


@dataclass(frozen=True)
class Criterion:
    """Events of one domain and concept set; ``nested`` must hold around each of them."""

    domain: str
    codeset_id: int | None = None
    first: bool = False
    date_range: tuple[datetime.date, datetime.date] | None = None
    visit_types: tuple[int, ...] | None = None
    record_types: tuple[int, ...] | None = None
    nested: Group | None = None


@dataclass(frozen=True)
class Correlated:
    """Count of criterion events from ``lower_offset`` to ``upper_offset`` days around the index.

    Without ``lower_offset`` the window opens with the observation period.
    """

    criterion: Criterion
    upper_offset: int = 0
    lower_offset: int | None = None
    min_count: int | None = None
    max_count: int | None = None

    @property
    def by_first_date(self) -> bool:
        """True where the earliest event in the observation period decides the criterion."""
        return self.lower_offset is None and (self.min_count, self.max_count) in (
            (1, None),
            (None, 0),
        )


@dataclass(frozen=True)
class Group:
    mode: str  # "ALL" or "ANY"
    members: tuple[Correlated | Group, ...]


def leaves(group: Group) -> Iterator[Correlated]:
    for member in group.members:
        if isinstance(member, Group):
            yield from leaves(member)
        else:
            yield member


def criterion_events(
    cdm: Cdm, codesets: DataFrame, criterion: Criterion, codeset_ids: list[int] | None
) -> DataFrame:
    return domain_events(
        cdm,
        codesets,
        criterion.domain,
        codeset_ids,
        criterion.first,
        criterion.date_range,
        criterion.visit_types,
        criterion.record_types,
    )


def criterion_days(
    cdm: Cdm, codesets: DataFrame, criterion: Criterion, codeset_ids: list[int] | None
) -> DataFrame:
    """Criterion events counted per set, person and day, inside observation.

    After this step a person holds at most one row per set and calendar day, however many events
    they have.
    """
    days = (
        criterion_events(cdm, codesets, criterion, codeset_ids)
        .groupBy("codeset_id", "person_id", "start_date")
        .agg(F.count("*").alias("n"))
    )
    days = in_observation(days, cdm["observation_period"])
    if criterion.nested is not None:
        days = filter_group(days, criterion.nested, cdm, codesets)
    return days


def windowed_counts(index: DataFrame, days: DataFrame, leaf: Correlated) -> DataFrame:
    """Events in each index window, from running sums over the calendar days of a period."""
    keys = ["person_id", "op_start_date"]
    low = F.col("op_start_date")
    if leaf.lower_offset is not None:
        low = F.greatest(low, F.date_add("start_date", leaf.lower_offset))
    high = F.least(F.col("op_end_date"), F.date_add("start_date", leaf.upper_offset))
    index_days = index.select(*keys, "op_end_date", "start_date").distinct()
    probes = index_days.select(
        *keys,
        "start_date",
        F.explode(
            F.array(
                F.struct(low.alias("day"), F.lit(-1).alias("side")),
                F.struct(high.alias("day"), F.lit(1).alias("side")),
            )
        ).alias("p"),
    ).select(*keys, "start_date", "p.day", "p.side", F.lit(0).cast("long").alias("n"))
    events = days.select(
        *keys,
        F.lit(None).cast("date").alias("start_date"),
        F.col("start_date").alias("day"),
        F.lit(0).alias("side"),
        "n",
    )
    # Same day: the lower probe comes before the events, the upper probe after them.
    running = Window.partitionBy(*keys).orderBy("day", "side")
    total = F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, 0))
    return (
        probes.unionByName(events)
        .withColumn("total", total)
        .filter("side <> 0")
        .groupBy(*keys, "start_date")
        .agg(F.greatest(F.sum(F.col("side") * F.col("total")), F.lit(0)).alias("count"))
    )


def filter_group(index: DataFrame, group: Group, cdm: Cdm, codesets: DataFrame) -> DataFrame:
    """Index events for which the group holds."""
    columns = index.columns
    known, (held,) = decide_groups(index, [group], cdm, codesets)
    return known.filter(held).select(*columns)


def group_mask(
    index: DataFrame, groups: list[Group], cdm: Cdm, codesets: DataFrame, name: str = "mask"
) -> DataFrame:
    """Index events with a bit for each group that holds, the first group lowest (63 at most)."""
    if len(groups) > 63:
        raise ValueError("more than 63 groups do not fit a mask")
    columns = index.columns
    if not groups:
        return index.withColumn(name, F.lit(0).cast("long"))
    known, held = decide_groups(index, groups, cdm, codesets)
    bits = [F.when(truth, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, truth in enumerate(held)]
    return known.select(*columns, reduce(lambda a, b: a + b, bits).alias(name))


def decide_groups(
    index: DataFrame, groups: list[Group], cdm: Cdm, codesets: DataFrame
) -> tuple[DataFrame, list[Column]]:
    """Index events with what decides the groups, and a truth column for each group.

    Criteria that differ only in their concept set share one scan, and all criteria decided by the
    earliest date share one aggregate and one join, whatever the number and size of the groups.
    """
    members = [leaf for group in groups for leaf in leaves(group)]
    families: dict[Criterion, list[int]] = {}
    for leaf in members:
        family = replace(leaf.criterion, codeset_id=None)
        families.setdefault(family, []).append(leaf.criterion.codeset_id)
    days = {
        family: criterion_days(
            cdm, codesets, family, None if ids == [None] else sorted(set(ids))
        )
        for family, ids in families.items()
    }
    numbers = {family: position for position, family in enumerate(families)}
    columns = index.columns
    truth: dict[int, Column] = {}

    quick = [(i, leaf) for i, leaf in enumerate(members) if leaf.by_first_date]
    if quick:
        wanted = {
            (numbers[replace(leaf.criterion, codeset_id=None)], leaf.criterion.codeset_id)
            for _, leaf in quick
        }
        used = {number for number, _ in wanted}
        stacked = reduce(
            DataFrame.unionByName,
            [
                d.select(
                    F.lit(numbers[family]).alias("family"),
                    "codeset_id",
                    "person_id",
                    "start_date",
                    "op_start_date",
                )
                for family, d in days.items()
                if numbers[family] in used
            ],
        )

        def date_name(number: int, codeset: int | None) -> str:
            return f"first_{number}_{codeset}"

        first_dates = stacked.groupBy(
            F.col("person_id").alias("f_person_id"), F.col("op_start_date").alias("f_op_start")
        ).agg(
            *[
                F.min(
                    F.when(
                        (F.col("family") == number) & F.col("codeset_id").eqNullSafe(codeset),
                        F.col("start_date"),
                    )
                ).alias(date_name(number, codeset))
                for number, codeset in sorted(wanted, key=str)
            ]
        )
        index = index.join(
            first_dates,
            (F.col("person_id") == F.col("f_person_id"))
            & (F.col("op_start_date") == F.col("f_op_start")),
            "left",
        )
        for i, leaf in quick:
            number = numbers[replace(leaf.criterion, codeset_id=None)]
            seen = F.coalesce(
                F.col(date_name(number, leaf.criterion.codeset_id))
                <= F.date_add("start_date", leaf.upper_offset),
                F.lit(False),
            )
            truth[i] = seen if leaf.min_count == 1 else ~seen

    for i, leaf in enumerate(members):
        if leaf.by_first_date:
            continue
        mine = days[replace(leaf.criterion, codeset_id=None)].filter(
            F.col("codeset_id").eqNullSafe(leaf.criterion.codeset_id)
        )
        counts = windowed_counts(index.select(*columns), mine, leaf).select(
            F.col("person_id").alias("c_person_id"),
            F.col("op_start_date").alias("c_op_start"),
            F.col("start_date").alias("c_start"),
            F.col("count").alias(f"count_{i}"),
        )
        index = index.join(
            counts,
            (F.col("person_id") == F.col("c_person_id"))
            & (F.col("op_start_date") == F.col("c_op_start"))
            & (F.col("start_date") == F.col("c_start")),
            "left",
        ).drop("c_person_id", "c_op_start", "c_start")
        count = F.coalesce(F.col(f"count_{i}"), F.lit(0))
        held = F.lit(True)
        if leaf.min_count is not None:
            held = held & (count >= leaf.min_count)
        if leaf.max_count is not None:
            held = held & (count <= leaf.max_count)
        truth[i] = held

    position = iter(range(len(members)))

    def combine(g: Group) -> Column:
        parts = [combine(m) if isinstance(m, Group) else truth[next(position)] for m in g.members]
        return reduce(lambda a, b: (a & b) if g.mode == "ALL" else (a | b), parts)

    return index, [combine(group) for group in groups]
