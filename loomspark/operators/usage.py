"""The log of calls to models: rows appended with what a call was estimated to cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.reads import estimated_cost, longest_prefix
from loomspark.operators.upsert import recorded

#: Columns of a usage row.
USAGE_COLUMNS = (
    "provider", "model", "conversation_id", "draft_revision_id", "input_tokens", "output_tokens", "total_tokens", "estimated_cost_usd",
    "outcome", "created_at",
)


def record_usage(calls: DataFrame, rates: DataFrame, path: str, log: Callable[[str], None] = print) -> dict[str, bool]:
    """Append the usage rows of ``calls`` to the log under ``path``, best effort (see ``recorded``).

    Calls have ``provider, model, conversation_id, draft_revision_id`` (null for one that made none),
    ``input_tokens, output_tokens, total_tokens, outcome, created_at``; a row also has the cost that
    was estimated when it was written, null for a model without a rate.
    """

    def write() -> None:
        cost = estimated_cost(F.col("input_tokens"), F.col("output_tokens")).alias("estimated_cost_usd")
        priced = longest_prefix(calls, rates, "model").select("*", cost)
        priced.select(*USAGE_COLUMNS).write.mode("append").parquet(path)

    return recorded(write, log)
