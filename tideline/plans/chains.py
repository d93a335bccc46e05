"""Chains of pointers followed to their ends by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans.scratch import discard, materialize


def follow(steps: DataFrame, rounds: int = 64) -> DataFrame:
    """(at, n): the sum of ``n`` along the chain from each of ``steps(at, next, n)`` to its end, where ``next`` is null.

    Steps that point nowhere are set aside at once, so joins have no null keys
    and each round handles only chains that still run. No two steps may point
    to one. A step whose next isn't there leads nowhere and is left out, with
    all before it; rings raise.
    """
    done = materialize(steps.where("next is null").select("at", "n"), "ended")
    ended, live = [done], materialize(steps.where("next is not null"), "chain")
    for _ in range(rounds):
        if live.isEmpty():
            out = ended[0]
            for more in ended[1:]:
                out = out.unionByName(more)
            return out
        targets = live.select(F.col("at").alias("next"), F.col("next").alias("after"), F.col("n").alias("more"))
        for part in ended:
            targets = targets.unionByName(part.select(F.col("at").alias("next"), F.lit(None).cast(live.schema["next"].dataType).alias("after"), F.col("n").alias("more")))
        doubled = materialize(live.join(targets, "next").select("at", F.col("after").alias("next"), (F.col("n") + F.col("more")).alias("n")), "doubled")
        ended.append(materialize(doubled.where("next is null").select("at", "n"), "ended"))
        discard(live)
        live = doubled.where("next is not null")
        live.scratch_path = doubled.scratch_path
    raise ValueError("some chains form a ring")
