"""Counters.  Everything is counted before it is joined."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confwarden import fixed
from confwarden.functions import final_outcome
from confwarden.operators.clients import CLIENT_KEY


def findings_by_client(clients: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per client and phase, zeros included."""
    phases = F.array(*[F.lit(p) for p in fixed.PHASES])
    grid = clients.select(*CLIENT_KEY, F.explode(phases).alias("phase"))
    counted = findings.groupBy(*CLIENT_KEY, "phase").agg(F.count("*").alias("found"))
    return grid.join(counted, [*CLIENT_KEY, "phase"], "left").select(
        *CLIENT_KEY, "phase", F.coalesce("found", F.lit(0)).alias("n")
    )


def policies_per_client(clients: DataFrame, policies: DataFrame) -> DataFrame:
    """Policies per client; a client with none stays, with 0."""
    counted = policies.groupBy(*CLIENT_KEY).agg(F.count("*").alias("found"))
    return (
        clients.select(*CLIENT_KEY)
        .join(counted, CLIENT_KEY, "left")
        .select(*CLIENT_KEY, F.coalesce("found", F.lit(0)).alias("n"))
    )


def outcomes_by_path(attempts: DataFrame) -> DataFrame:
    """What became of each path after all attempts on it: one success is enough."""
    done = F.bool_or(final_outcome(F.col("http_code")) == "OK")
    return attempts.groupBy("resource_path").agg(
        F.when(done, "OK").otherwise("FAIL").alias("outcome")
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


SUMMARY = (
    "realms_processed",
    "clients_checked",
    "dead_policies",
    "dead_permissions",
    "deleted",
    "delete_failures",
)


def run_summary(
    realms: DataFrame,
    clients: DataFrame | None = None,
    policies: DataFrame | None = None,
    permissions: DataFrame | None = None,
    outcomes: DataFrame | None = None,
) -> DataFrame:
    """One row of six counters.

    Each input is reduced to one row, and these are stacked and added up; a counter with
    no input is 0.  In a dry run there are no outcomes.
    """

    def counter(df, name, condition=None):
        n = F.count("*") if condition is None else F.count_if(condition)
        return df.agg(n.alias("n")).select(F.lit(name).alias("counter"), "n")

    given = zip((realms, clients, policies, permissions), SUMMARY, strict=False)
    parts = [counter(df, name) for df, name in given if df is not None]
    if outcomes is not None:
        tally = outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
        name = F.when(F.col("outcome") == "OK", "deleted").otherwise("delete_failures")
        parts.append(tally.select(name.alias("counter"), "n"))
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c)
            for c in SUMMARY
        ]
    )
