"""Stage counts per pipeline, the stability gate, throughput and the cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.functions import coerce as C

# Stage events: event_id, doc_id, pipeline_id, stage, ts_ms.


def latest_stages(events: DataFrame) -> DataFrame:
    """Current stage of every document in its pipeline."""
    return (
        events.groupBy("pipeline_id", "doc_id")
        .agg(F.max(F.struct("ts_ms", "event_id", "stage")).alias("last"))
        .select("pipeline_id", "doc_id", "last.stage", "last.ts_ms", "last.event_id")
    )


def stage_counts(events: DataFrame) -> DataFrame:
    return (
        latest_stages(events)
        .groupBy("pipeline_id", "stage")
        .agg(F.count(F.lit(1)).alias("doc_count"))
    )


def status_of(counts: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Counts by kind for each wanted pipeline; an unknown one has zeros."""
    n = F.col("doc_count")
    stage = F.col("stage")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    folded = counts.groupBy("pipeline_id").agg(
        total(stage == "pending").alias("pending_count"),
        total(~stage.isin(*settings.SETTLED_STAGES)).alias("processing_count"),
        total(stage == "failed").alias("failed_count"),
        total(stage == "indexed").alias("indexed_count"),
    )
    names = ("pending_count", "processing_count", "failed_count", "indexed_count")
    return (
        pipelines.select("pipeline_id")
        .distinct()
        .join(folded, "pipeline_id", "left")
        .select("pipeline_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    )


def stability(
    status: DataFrame, allowed_processing: int | Column = 0, allow_failed: bool = False
) -> DataFrame:
    """Status rows with ``stable``: nothing waits, runs or (unless allowed) failed.

    ``allowed_processing`` is one allowance for all, or a Column that gives each
    pipeline its own.
    """
    at_rest = (F.col("pending_count") == 0) & (F.col("processing_count") <= allowed_processing)
    if not allow_failed:
        at_rest = at_rest & (F.col("failed_count") == 0)
    return status.withColumn("stable", at_rest)


def blockers(gate: DataFrame) -> DataFrame:
    return gate.filter(~F.col("stable"))


def all_stable(gate: DataFrame) -> DataFrame:
    return gate.agg(F.coalesce(F.bool_and("stable"), F.lit(False)).alias("stable"))


def whole(x: str) -> str:
    """SQL of a whole number; a true/false count is one to the service."""
    return (
        f"case when {C.kind_sql(x)} = 'BIGINT' then try_cast({C.text_sql(x)} as bigint)"
        f" when {C.kind_sql(x)} = 'BOOLEAN' then if({C.text_sql(x)} = 'true', 1L, 0L) end"
    )


def status_from_json(statuses: DataFrame, raw: str = "status") -> DataFrame:
    """Status rows of JSON status text.

    A waiting, running or failed count that the status states itself goes before
    what its stage counts add up to.
    """
    stated = ("pending_count", "processing_count", "failed_count")
    counted = status_of(counts_from_status(statuses, raw), statuses)
    own = statuses.select("pipeline_id", F.try_parse_json(F.col(raw)).alias("v")).select(
        "pipeline_id", *[F.expr(whole(C.field_sql("v", n))).alias(f"_{n}") for n in stated]
    )
    return counted.join(own, "pipeline_id").select(
        "pipeline_id", *[F.coalesce(f"_{n}", n).alias(n) for n in stated], "indexed_count"
    )


def counts_from_status(statuses: DataFrame, raw: str = "status") -> DataFrame:
    """``(pipeline_id, stage, doc_count)`` from JSON status text of any encoding.

    Under ``stages``, ``stage_counts`` or ``counts`` (first one that is an object or
    a list wins) there is either stage to count, or a list of stage/count rows;
    a status with none of them is itself read as stage to count. Only whole
    numbers count.
    """
    usable = {n: C.is_container_sql(C.field_sql("v", n)) for n in ("stages", "stage_counts", "counts")}
    branches = " ".join(f"when {test} then {C.field_sql('v', n)}" for n, test in usable.items())
    chosen = statuses.select(
        "pipeline_id", F.try_parse_json(F.col(raw)).alias("v")
    ).select("pipeline_id", F.expr(f"case {branches} else v end").alias("c"))

    stage, count = C.field_sql("r", "stage"), C.field_sql("r", "count")
    unfolded = chosen.select(
        "pipeline_id",
        F.expr(
            f"transform({C.list_sql('c')}, r -> struct("
            f"if({stage} is null or {C.kind_sql(stage)} = 'VOID', null, {C.display_text_sql(stage)}) as stage,"
            f" {whole(count)} as doc_count))"
        ).alias("listed"),
        F.expr(
            f"transform(map_entries({C.object_sql('c')}), e -> struct(e.key as stage, {whole('e.value')} as doc_count))"
        ).alias("mapped"),
    )
    good = "filter(coalesce(listed, mapped), r -> r.stage is not null and r.doc_count is not null)"
    placed = unfolded.select("pipeline_id", F.expr(f"posexplode({good})").alias("at", "s"))
    # A later row of one stage replaces an earlier one.
    return placed.groupBy("pipeline_id", "s.stage").agg(
        F.max_by("s.doc_count", "at").alias("doc_count")
    )


def index_throughput(events: DataFrame, window_minutes: int) -> DataFrame:
    """Documents indexed per minute in each trailing window with any event."""
    slot = F.window(F.timestamp_millis("ts_ms"), f"{window_minutes} minutes")
    return (
        events.groupBy("pipeline_id", slot.alias("w"))
        .agg(F.count_if(F.col("stage") == "indexed").alias("indexed"))
        .select(
            "pipeline_id",
            F.unix_millis("w.end").alias("window_end_ms"),
            "indexed",
            (F.col("indexed") / window_minutes).alias("per_minute"),
        )
    )


def refresh_cursor(checkpoints: DataFrame) -> DataFrame:
    """Rows taken by all checkpoints so far; a negative count adds nothing."""
    return checkpoints.agg(
        F.coalesce(F.sum(F.greatest("row_count", F.lit(0))), F.lit(0)).alias("row_cursor")
    )
