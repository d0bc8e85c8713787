"""A1 session-cost roll-up, J2 prompt/session-cost join, J3 favourite model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_cost(api_requests: DataFrame) -> DataFrame:
    """A1: lifetime cost per session, unfiltered (K3).

    Partial aggregation runs map-side, so a session holding a large share of all
    requests collapses to one row per task before the shuffle.
    """
    return api_requests.groupBy("session_id").agg(F.sum("cost_usd").alias("session_cost"))


def prompts_with_session_cost(prompts: DataFrame, costs: DataFrame,
                              keys: list[str]) -> DataFrame:
    """J2 without the per-prompt fan-out in the shuffle.

    The reference joins every prompt row to its session's cost, so a session with
    n prompts adds its cost n times to a SUM (K1).  We keep that result but
    pre-aggregate prompts to one row per (session, keys) carrying ``n_prompts``
    first; the join then moves one row per session and group instead of one per
    prompt.  ``costs`` is the A1 roll-up (``Tables.session_cost()``).  Output:
    keys..., session_id, n_prompts, session_cost (NULL when the session has no
    requests).
    """
    per_session = prompts.groupBy("session_id", *keys).agg(F.count(F.lit(1)).alias("n_prompts"))
    return per_session.join(costs, "session_id", "left")


def weighted_cost_sum(col: str = "session_cost", weight: str = "n_prompts"):
    """SUM over prompt rows of the session cost == SUM(cost * n_prompts) (NULLs skipped)."""
    return F.sum(F.col(col) * F.col(weight))


def favourite_model(api_requests: DataFrame, emails: DataFrame | None = None) -> DataFrame:
    """Most used model per user over all requests, ignoring filters (K7).

    Ties go to the lowest model name.  ``mode`` keeps one counter per distinct
    model in the aggregation buffer and merges partially, so a user with a huge
    share of requests does not land in one task.  With ``emails`` (a bounded set
    such as the top 10) only those users' requests are aggregated.
    """
    ar = api_requests.select("user_email", "model")
    if emails is not None:
        ar = ar.join(F.broadcast(emails.select(F.col("email").alias("user_email"))),
                     "user_email", "left_semi")
    return ar.groupBy("user_email").agg(F.mode("model", deterministic=True).alias("preferred_model"))
