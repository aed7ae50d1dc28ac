"""Roll-ups of the block ledger: failure reasons, retries, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The known failure reasons; any other text counts as unknown.
REASONS = ["signature_miss", "margin_miss", "no_block_generated", "unknown"]


def known(reason: Column) -> Column:
    """The reason, ``unknown`` for other text, null for null."""
    return F.when(reason.isin(REASONS), reason).when(reason.isNotNull(), F.lit("unknown"))


def reason_of(in_valid_set: Column, margin_passed: Column) -> Column:
    """Why a check failed: signature first; a null, or both true, is unknown."""
    return F.when(in_valid_set & margin_passed, "unknown").when(in_valid_set.isNull() | margin_passed.isNull(), "unknown").when(~in_valid_set, "signature_miss").otherwise("margin_miss")


def reason_histogram(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., reason, n)`` over first checks, attempts and final outcomes; only reasons that occur have a row."""
    reasons = F.array_compact(F.concat(F.array(known(F.col("initial_verify.failure_reason"))), F.transform(F.coalesce("retry_attempts", F.array().cast("array<struct<attempt_index:int,produced_block:boolean,failure_reason:string>>")), lambda a: known(a["failure_reason"])), F.array(known(F.col("final_outcome.failure_reason")))))
    return ledger.select(*keys, F.explode(reasons).alias("reason")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def retries(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., blocks, blocks_with_retry, attempts_total, attempts_no_block, retry_rescued, retry_exhausted, cascade_rescued, rescued)``.

    A block rescued by both counts once in ``rescued``. An attempt without ``produced_block`` made no block. Null
    elements of arrays are left out.
    """
    tries = F.filter(F.coalesce("retry_attempts", F.array().cast("array<struct<attempt_index:int,produced_block:boolean,failure_reason:string>>")), lambda a: a.isNotNull())
    yes = lambda c: F.coalesce(F.col(f"final_outcome.{c}"), F.lit(False))
    return ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(F.size(tries) > 0).alias("blocks_with_retry"),
        F.sum(F.size(tries)).alias("attempts_total"),
        F.sum(F.size(F.filter(tries, lambda a: ~F.coalesce(a["produced_block"], F.lit(False))))).alias("attempts_no_block"),
        F.count_if(yes("rescued_by_retry")).alias("retry_rescued"),
        F.count_if(yes("exhausted_retries")).alias("retry_exhausted"),
        F.count_if(yes("rescued_by_cascade")).alias("cascade_rescued"),
        F.count_if(yes("rescued_by_retry") | yes("rescued_by_cascade")).alias("rescued"),
    )


def cascades(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., triggers, rollbacks)``: events of a sample, one that several blocks hold counting once.

    Events are the same by rollback_id or, without one, by all of their content.
    """
    e = ledger.select(*keys, F.explode("cascade_events").alias("e")).filter("e is not null")
    ident = F.coalesce("e.rollback_id", F.to_json("e"))
    once = e.groupBy(*keys, ident.alias("__i")).agg(F.max(F.coalesce("e.triggered", F.lit(False))).alias("t"), F.max(F.col("e.rollback_id").isNotNull()).alias("r"))
    return once.groupBy(*keys).agg(F.count_if("t").alias("triggers"), F.count_if("r").alias("rollbacks"))
