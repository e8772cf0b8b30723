"""Conditional upserts as a full outer join that classifies rows; keys are compared null-safely."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unused
from .dedup import keep_first


@dataclass(frozen=True)
class Policy:
    """key; columns that a change in which makes an update; columns that an update sets; rises: a column whose larger
    staged value makes an update, too; arrival: the staged column that says which row of a key came last."""

    key: tuple[str, ...]
    compare: tuple[str, ...]
    update: tuple[str, ...]
    rises: str | None = None
    arrival: str = "arrival"


# What the three loaders compare and set.
WEB = Policy(("website_url", "company_name"), ("industry",), ("industry",))
REGISTER = Policy(
    ("abn",),
    ("entity_type", "entity_status", "address_line1", "suburb", "state", "postcode", "start_date"),
    ("entity_type", "entity_status", "address_line1", "address_line2", "suburb", "state", "postcode", "start_date"),
)
MATCHES = Policy(
    ("abn", "url", "company_name", "abr_company"),
    ("industry", "entity_type", "entity_status"),
    ("industry", "entity_type", "entity_status", "address", "postcode", "state", "start_date", "match_confidence", "source_commoncrawl_id", "source_abr_id"),
    rises="match_confidence",
)


def latest(stage: DataFrame, policy: Policy) -> DataFrame:
    """The last row of each key by arrival, without that column. A stage without it counts in the order in which it is read,
    as chunks that are loaded one after the other."""
    at = policy.arrival
    if at not in stage.columns:
        at = unused(stage, "_at")
        stage = stage.withColumn(at, F.monotonically_increasing_id())
    ties = [F.col(f"`{c}`").desc_nulls_last() for c in stage.columns if c != at and c not in policy.key]
    return keep_first(stage, list(policy.key), [F.col(f"`{at}`").desc_nulls_last(), *ties]).drop(at)


def classify(target: DataFrame, stage: DataFrame, policy: Policy, now: Column | None = None) -> DataFrame:
    """The target after the upsert, with `action`: INSERT, UPDATE, NOOP (staged, no change) or KEEP (not staged). Of several
    staged rows of a key the last counts. now: what inserts set created_at and updated_at to, and updates updated_at, where
    the target has these columns. A target that has a column `action` of its own gets the action as `_action`."""
    if policy.arrival in target.columns:
        target = target.drop(policy.arrival)
    stage = latest(stage, policy)
    old, new, action = unused(target, "_old"), unused(stage, "_new"), unused(target, "action")
    t, s = target.withColumn(old, F.lit(True)).alias("t"), stage.withColumn(new, F.lit(True)).alias("s")
    same = F.lit(True)
    for k in policy.key:
        same = same & F.col(f"t.`{k}`").eqNullSafe(F.col(f"s.`{k}`"))
    changed = F.lit(False)
    for c in policy.compare:
        if c in target.columns and c in stage.columns:
            changed = changed | ~F.col(f"t.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
    if policy.rises:
        changed = changed | F.coalesce(F.col(f"t.{policy.rises}") < F.col(f"s.{policy.rises}"), F.lit(False))
    kind = F.when(F.col(f"t.{old}").isNull(), "INSERT").when(F.col(f"s.{new}").isNull(), "KEEP").when(changed, "UPDATE").otherwise("NOOP")
    joined = t.join(s, same, "full_outer")
    cols = []
    for c in target.columns:
        stamped = now is not None and c in ("created_at", "updated_at")
        staged = now if stamped else F.col(f"s.`{c}`") if c in stage.columns else F.lit(None)
        takes = kind == "INSERT"
        if c in policy.update or stamped and c == "updated_at":
            takes = takes | (kind == "UPDATE")
        cols.append(F.when(takes, staged).otherwise(F.col(f"t.`{c}`")).alias(c))
    return joined.select(*cols, kind.alias(action))


def accounting(classified: DataFrame) -> DataFrame:
    """Rows by action; processed rows are INSERT + UPDATE + NOOP."""
    return classified.groupBy("action").agg(F.count("*").alias("n"))
