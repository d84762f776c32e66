"""From a log of fetch attempts to one outcome per URL, and the waits a retry policy implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut
from pagemill.sources.places import PLACE, read_at, with_places

# Status codes worth another attempt after a wait.
RETRYABLE = (403, 429, 503)


def is_retryable(status: Column | str = "status") -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return F.coalesce(status.isin(*RETRYABLE), F.lit(False))


def is_deciding(status: Column | str = "status") -> Column:
    """A 200 or a terminal 4xx ends the attempts; anything else uses one up."""
    status = F.col(status) if isinstance(status, str) else status
    terminal = status.between(400, 499) & ~is_retryable(status)
    return F.coalesce((status == 200) | terminal, F.lit(False))


def fetch_outcomes(
    log: DataFrame, max_retries: int = 3, keys: tuple[str, ...] = ("url",)
) -> DataFrame:
    """One row per URL: `outcome` ok or failed, why, attempts used, and the body if ok.

    The first deciding attempt within the limit counts. A 200 without a body is a failure. The
    outcome is decided without the bodies; those of the deciding attempts are then read where they
    lie, and are in no shuffle.
    """
    tried = with_places(log.filter(F.col("attempt").between(1, max_retries)))
    decides = is_deciding("status")
    first = F.when(decides, F.struct("attempt", "attempted_at", PLACE))
    has_body = F.coalesce(F.col("body"), F.lit("")) != ""
    per_url = tried.groupBy(*keys).agg(
        F.min_by(F.struct("attempt", "attempted_at", "status", has_body.alias("has_body"), PLACE), first).alias("first"),
        F.max("attempt").alias("last_attempt"),
        F.max_by("error", F.struct("attempt", "attempted_at")).alias("last_error"),
        F.max_by("status", F.struct("attempt", "attempted_at")).alias("last_status"),
    )
    status = F.col("first.status")
    ok = F.coalesce((status == 200) & F.col("first.has_body"), F.lit(False))
    reason = (
        F.when(ok, F.lit("ok"))
        .when(status == 200, F.lit("empty body"))
        .when(status.isNotNull(), F.concat(F.lit("status "), status.cast("string")))
        .otherwise(
            F.concat(
                F.lit("gave up: "),
                F.coalesce("last_error", F.concat(F.lit("status "), "last_status"), F.lit("")),
            )
        )
    )
    decided = cut(
        per_url.select(
            *keys,
            F.when(ok, F.lit("ok")).otherwise(F.lit("failed")).alias("outcome"),
            reason.alias("reason"),
            F.coalesce("first.attempt", "last_attempt").alias("attempts"),
            F.col("first.attempted_at").alias("attempted_at"),
            F.col(f"first.{PLACE}").alias(PLACE),
        )
    )

    def bodies(rows: DataFrame) -> DataFrame:
        won = F.lit("ok")
        return rows.select(*keys, won.alias("outcome"), won.alias("reason"), F.col("attempt").alias("attempts"), F.col("body").alias("html"))

    failed = decided.filter("outcome = 'failed'").select(
        *keys, "outcome", "reason", "attempts", F.lit(None).cast("string").alias("html")
    )
    winners = decided.filter("outcome = 'ok'").withColumn("attempt", F.col("attempts"))
    return read_at(tried, winners, bodies, by=(*keys, "attempt", "attempted_at")).unionByName(failed)


def failed_fetches(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("outcome") == "failed")


def fetched_pages(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("outcome") == "ok").drop("outcome", "reason", "attempts")


def retry_waits(log: DataFrame, delay: Column | float, max_retries: int = 3) -> DataFrame:
    """Add `wait_sec` per attempt: delay * 2^attempt after a retryable status or a network error.

    A row-local rule: it needs no shuffle.
    """
    delay = F.lit(delay) if isinstance(delay, (int, float)) else delay
    again = is_retryable("status") | F.col("error").isNotNull()
    wait = F.when(again, delay * F.pow(F.lit(2.0), F.col("attempt"))).otherwise(F.lit(0.0))
    return log.filter(F.col("attempt").between(1, max_retries)).withColumn("wait_sec", wait)


def total_waits(waits: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    return waits.groupBy(*keys).agg(F.sum("wait_sec").alias("total_wait_sec"))
