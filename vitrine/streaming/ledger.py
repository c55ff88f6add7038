"""Live stage of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.pipeline_status import latest_stages
from vitrine.operators.topk import top_k_per_key
from vitrine.streaming.runner import BATCH


def live_stages(events: DataFrame) -> DataFrame:
    """Current stage per document; run it in update mode."""
    return latest_stages(events)


def settled_stages(updates: DataFrame) -> DataFrame:
    """Newest update of every document from the written batches."""
    newest = top_k_per_key(updates, ["pipeline_id", "doc_id"], [F.col(BATCH).desc()], 1)
    return newest.drop("rank", BATCH)
