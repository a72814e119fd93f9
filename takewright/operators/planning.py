"""Session planning: which prompts to record next, by what they would add to what is covered."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, js_round_int

#: What a value not covered yet is worth, by field.
WEIGHTS = {"intent": 42, "pace": 24, "energy": 16, "tone": 10, "articulation": 8, "projection": 8, "pitch": 8, "pause": 6, "variation": 6, "attack": 6, "ending": 6, "intimacy": 6}


def budget(minutes: Column) -> Column:
    return clamp(js_round_int(minutes * 1.2), 1, 8)


def greedy(candidates: DataFrame, covered: DataFrame, key: str, fields: list[str], size: int = 8, order: str = "ord") -> DataFrame:
    """For each key the ``size`` prompts that add most, one after another; ties to the earliest.

    Only the earliest prompt of each combination of field values can ever be chosen before another of that combination, so the groups
    that are planned in one task hold at most ``size`` prompts of each combination.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key, *fields).orderBy(order))
    some = candidates.withColumn("_r", rank).where(F.col("_r") <= size).drop("_r")
    known = covered.groupBy(key).agg(*(F.collect_set(f).alias(f"seen_{f}") for f in fields))
    some = some.join(known, key, "left")
    schema = f"{key} {dict(candidates.dtypes)[key]}, place int, prompt_id long, gain int"

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        seen = {f: set([] if pdf[f"seen_{f}"].iloc[0] is None else pdf[f"seen_{f}"].iloc[0]) for f in fields}
        rows, left = [], pdf.to_dict("records")
        for place in range(min(size, len(left))):
            best = max(range(len(left)), key=lambda i: (sum(WEIGHTS[f] for f in fields if left[i][f] not in seen[f]), -i))
            row = left.pop(best)
            rows.append((row[key], place, row["prompt_id"], sum(WEIGHTS[f] for f in fields if row[f] not in seen[f])))
            for f in fields:
                seen[f].add(row[f])
        return pd.DataFrame(rows, columns=[key, "place", "prompt_id", "gain"])

    return some.groupBy(key).applyInPandas(plan, schema)


def plan_session(prompts: DataFrame, completed: DataFrame, attempted: DataFrame, key: str, size: int, order: str = "ord") -> DataFrame:
    """Sequential: the first ``size`` open prompts, those never tried before those tried; all prompts where none is open."""
    from pyspark.sql import Window

    x = prompts.join(completed.select("prompt_id", F.lit(True).alias("_done")).distinct(), "prompt_id", "left")
    x = x.join(attempted.select("prompt_id", F.lit(True).alias("_tried")).distinct(), "prompt_id", "left")
    w = Window.partitionBy(key)
    open_ = F.count(F.when(F.col("_done").isNull(), 1)).over(w) > 0
    x = x.where("true").withColumn("_open", open_).where(~F.col("_open") | F.col("_done").isNull())
    rank = F.row_number().over(w.orderBy(F.coalesce("_tried", F.lit(False)), order))
    return x.withColumn("place", rank.cast("long")).where(F.col("place") <= size).select(key, "place", "prompt_id")
