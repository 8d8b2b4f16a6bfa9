"""Choice among plans per block, loss triggers and the online state machine."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOSS_SHARE, SPAN, LOSSES, GAP, COOLDOWN, PUBLICATIONS, ATTEMPTS = 0.99, 5, 3, 10, 10, 5, 8


def choose(totals: DataFrame) -> DataFrame:
    """Cheaper of a block's plan and empty totals, and whether the plan counts as lost (columns block_id, plan_total, empty_total)."""
    plan, empty = F.col("plan_total"), F.col("empty_total")
    return totals.withColumn("chosen", F.when(plan < empty, "plan").otherwise("empty")).withColumn("total", F.least(plan, empty)).withColumn("loss", (plan >= empty) | (plan > LOSS_SHARE * empty))


def losses_in_span(choices: DataFrame, key: str) -> DataFrame:
    """Losses among a key's last SPAN blocks and whether they fire: at least LOSSES losses in at least LOSSES blocks."""
    w = Window.partitionBy(key).orderBy("block_id").rowsBetween(-(SPAN - 1), 0)
    seen = F.count("*").over(w)
    return choices.withColumn("losses", F.sum(F.col("loss").cast("long")).over(w)).withColumn("fired", (F.col("losses") >= LOSSES) & (seen >= LOSSES))


def cumulative_ratio(blocks: DataFrame, key: str, raw: str, archive: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("ratio", F.round(F.sum(raw).over(w) / F.sum(archive).over(w), 6))


class Event(NamedTuple):
    block: int
    kind: str  #: "attempt" or "publish"


def evolve(costs: Iterable[tuple[int, int, int, int]]) -> list[Event]:
    """The online policy over (block, best published, empty, candidate) costs, in block order.

    Losses in the last SPAN blocks trigger an attempt, GAP blocks after the last one and COOLDOWN after a publication; a candidate
    is published where it costs at most LOSS_SHARE of the current best on the next block, effective from the one after.
    """
    rows, events, recent = list(costs), [], []
    last_attempt = last_publish = -(10**9)
    attempts = publications = 0
    for i, (block, best, empty, _) in enumerate(rows):
        recent = (recent + [best >= empty or best > LOSS_SHARE * empty])[-SPAN:]
        ready = block - last_attempt >= GAP and block - last_publish >= COOLDOWN and attempts < ATTEMPTS and publications < PUBLICATIONS
        if ready and len(recent) >= LOSSES and sum(recent) >= LOSSES and i + 1 < len(rows):
            attempts, last_attempt = attempts + 1, block
            events.append(Event(block, "attempt"))
            _, next_best, next_empty, candidate = rows[i + 1]
            if candidate <= LOSS_SHARE * min(next_best, next_empty):
                publications, last_publish = publications + 1, block + 2
                events.append(Event(block + 2, "publish"))
    return events
