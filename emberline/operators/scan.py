"""Parallel scans: what associative maps of consecutive chunks make of each other, composed in Spark by levels.

A level groups the chunks of a key by `fan` consecutive numbers and composes each
group to one; the next level does the same with the groups, until each key has one.
On the way back each group's members get what lies before them: the group's own
prefix, and the members before them inside. A task holds `fan` rows of a group, and
the driver none; c chunks take about 2 log(c) / log(fan) shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 1000


def exclusive_scan(parts: DataFrame, by: str, compose: Callable[[tuple, tuple], tuple], chunks: int, fan: int = FAN) -> DataFrame:
    """parts (by: string, chunk: int from 0 below `chunks`, then the state's columns) with each state replaced by all of the key's chunks before, composed in order; chunks with none before are left out.

    compose(a, b): the state of a, then b; associative. parts is read at each level,
    so it should be written or cheap.
    """
    fields = parts.schema.fields
    by_type, state = fields[0].dataType.simpleString(), [f.name for f in fields[2:]]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields[2:])

    def states(pdf: pd.DataFrame) -> list[tuple]:
        return [tuple(None if pd.isna(x) else x for x in r) for r in pdf[state].itertuples(index=False)]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        total = None
        for s in states(pdf):
            total = s if total is None else compose(total, s)
        return pd.DataFrame([(pdf[by].iloc[0], int(pdf["chunk"].iloc[0]) // fan, *total)], columns=[by, "chunk", *state])

    def spread(members: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("chunk")
        total, out = (states(before)[0] if len(before) else None), []
        for user, chunk, s in zip(members[by], members["chunk"], states(members), strict=True):
            if total is not None:
                out.append((user, chunk, *total))
            total = s if total is None else compose(total, s)
        return pd.DataFrame(out, columns=[by, "chunk", *state])

    schema = f"{by} {by_type}, chunk int, {kinds}"
    group = F.floor(F.col("chunk") / fan).cast("int")
    levels = [parts]
    while chunks > 1:
        chunks = -(-chunks // fan)
        levels.append(levels[-1].groupBy(by, group.alias("group")).applyInPandas(fold, schema))
    prefix = parts.limit(0)  # before the whole there is nothing
    for level in reversed(levels[:-1]):
        prefix = level.groupBy(by, group.alias("group")).cogroup(prefix.groupBy(by, F.col("chunk").alias("group"))).applyInPandas(spread, schema)
    return prefix
