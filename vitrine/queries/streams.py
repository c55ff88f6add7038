"""Streams run to their end over the event table, checked as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import fixtures
from vitrine.fixtures import with_views
from vitrine.queries.registry import query
from vitrine.queries.trending import NORMALIZED
from vitrine.streaming import attribution, history, ledger, runner, trending


def stream_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived view over the event table read as a stream."""
    text = fixtures.VIEWS[name]
    inputs = {"events": runner.file_stream(spark, folder, "events.parquet")}
    if "{part}" in text:
        inputs["part"] = fixtures.table(spark, folder, "part")
    return spark.sql(
        text.format(**fixtures.SPARK_WORDS, **{t: "{" + t + "}" for t in inputs}), **inputs
    )


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.timestamp_millis("timestamp_ms"))


def searches(spark: SparkSession, folder: str) -> DataFrame:
    return timed(stream_view(spark, folder, "search_history").filter(F.col("page_tag") == "page:first"))


# Windows end at whole hours and are written once the watermark, a day behind the
# newest event that was read, has passed their end.
WINDOWS = f"""
keyed as (select {NORMALIZED} as query, timestamp_ms from search_history
          where page_tag='page:first' and length({NORMALIZED}) between 1 and 160),
spread as (select query, (timestamp_ms//3600000+1+unnest(range(24)))*3600000 as window_end_ms from keyed),
counts as (select window_end_ms, query, count(*) as "count" from spread
           where window_end_ms<=(select max(timestamp_ms) from keyed)-86400000 group by all)
"""


def sliding(spark: SparkSession, folder: str) -> DataFrame:
    return runner.run_to_end(trending.sliding_counts(searches(spark, folder)))


@query(
    "stream_sliding_counts",
    covers="T1",
    sql=with_views("search_history", extra=WINDOWS) + "select * from counts",
)
def stream_sliding_counts(spark: SparkSession, folder: str) -> DataFrame:
    return sliding(spark, folder).select(
        F.unix_millis("window_end").alias("window_end_ms"), "query", "count"
    )


@query(
    "stream_trending_windows",
    covers="T1 A1",
    sql=with_views("search_history", extra=WINDOWS)
    + """select window_end_ms, query, "count", row_number() over (partition by window_end_ms order by "count" desc, query) as rank
    from counts where "count">=2 qualify rank<=12""",
)
def stream_trending_windows(spark: SparkSession, folder: str) -> DataFrame:
    return trending.top_per_window(sliding(spark, folder)).select(
        F.unix_millis("window_end").alias("window_end_ms"),
        "query",
        "count",
        F.col("rank").cast("long").alias("rank"),
    )


@query(
    "stream_trending_now",
    covers="T1 A1",
    sql=with_views("search_history", extra=f"""
keyed as (select {NORMALIZED} as query, (timestamp_ms//3600000+1)*3600000 as slot_end from search_history
          where page_tag='page:first' and length({NORMALIZED}) between 1 and 160),
newest as (select max(slot_end) as window_end_ms from keyed),
counts as (select window_end_ms, query, count(*) as "count" from keyed, newest
           where slot_end>window_end_ms-86400000 group by all)
""")
    + """select window_end_ms, query, "count", row_number() over (order by "count" desc, query) as rank
    from counts where "count">=2 qualify rank<=12""",
)
def stream_trending_now(spark: SparkSession, folder: str) -> DataFrame:
    """The window that ends with the newest search, without waiting for the watermark."""
    updates = runner.run_to_end(trending.slot_counts(searches(spark, folder)), "update")
    top = trending.top_per_window(trending.current_counts(updates))
    return top.select(
        F.unix_millis("window_end").alias("window_end_ms"), "query", "count", F.col("rank").cast("long").alias("rank")
    )


@query(
    "stream_click_attribution",
    covers="T2 J3",
    sql=with_views("search_history", "clickstream", extra=f"""
    keyed as (select event_id, trace_id, top_result_ids, timestamp_ms, {NORMALIZED} as query from search_history
              where page_tag='page:first' and length({NORMALIZED}) between 1 and 160),
    listed as (select event_id, query, trace_id, timestamp_ms, unnest(top_result_ids) as doc_id, unnest(range(len(top_result_ids))) as pos from keyed),
    placed as (select event_id, query, trace_id, timestamp_ms, doc_id, max(pos) as pos from listed group by all)""")
    + """select p.event_id as search_id, c.event_id as click_id, trace_id, query, doc_id, pos as rank
    from placed p join clickstream c using (trace_id, doc_id) where abs(c.timestamp_ms-p.timestamp_ms)<=86400000""",
)
def stream_click_attribution(spark: SparkSession, folder: str) -> DataFrame:
    clicks = timed(stream_view(spark, folder, "clickstream"))
    found = runner.run_to_end(trending.attributed_clicks(searches(spark, folder), clicks))
    return found.select(
        "search_id", "click_id", "trace_id", "query", "doc_id", F.col("rank").cast("long").alias("rank")
    )


@query(
    "stream_stage_ledger",
    covers="T5 A7",
    sql=with_views("stage_events")
    + """select pipeline_id, doc_id, arg_max(stage,(ts_ms,event_id)) as stage, max(ts_ms) as ts_ms from stage_events group by all""",
)
def stream_stage_ledger(spark: SparkSession, folder: str) -> DataFrame:
    updates = runner.run_to_end(
        ledger.live_stages(stream_view(spark, folder, "stage_events")), "update"
    )
    return ledger.settled_stages(updates).select("pipeline_id", "doc_id", "stage", "ts_ms")


def with_timed_state(stream: DataFrame, mode: str) -> DataFrame:
    """Drain a stream that needs the RocksDB state store."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, history.STATE_PROVIDER)
    try:
        return runner.run_to_end(stream, mode)
    finally:
        spark.conf.set(name, before)


def finished_lists(updates: DataFrame) -> DataFrame:
    return history.current_lists(with_timed_state(updates, "update"))


@query(
    "stream_counted_attribution",
    covers="T2 J3",
    sql=with_views("search_history", "clickstream", extra=f"""
    keyed as (select event_id, trace_id, top_result_ids, timestamp_ms//60000 as slot, {NORMALIZED} as query from search_history
              where page_tag='page:first' and trace_id<>'' and length({NORMALIZED}) between 1 and 160),
    listed as (select event_id, query, trace_id, slot, unnest(top_result_ids) as doc_id, unnest(range(len(top_result_ids))) as pos from keyed),
    placed as (select event_id, query, trace_id, slot, doc_id, max(pos) as rank from listed where doc_id is not null group by all),
    shown as (select trace_id, doc_id, query, rank, count(*) as searches from placed group by all),
    met as (select p.trace_id, p.doc_id, p.query, p.rank, count(*) as meetings from placed p
            join clickstream c on c.trace_id=p.trace_id and c.doc_id=p.doc_id and abs(c.timestamp_ms//60000-p.slot)<=1440 group by all)""")
    + "select trace_id, doc_id, query, rank, searches, meetings from shown join met using (trace_id, doc_id, query, rank)",
)
def stream_counted_attribution(spark: SparkSession, folder: str) -> DataFrame:
    clicks = timed(stream_view(spark, folder, "clickstream"))
    added = with_timed_state(attribution.counted_attribution(searches(spark, folder), clicks), "append")
    return attribution.attribution_counts(added).withColumn("rank", F.col("rank").cast("long"))


@query(
    "stream_recent_views",
    covers="T6 R10",
    sql=with_views("user_views", extra="""latest as (select user_id, doc_id, max((ts_ms, event_id)) as met from user_views group by all)""")
    + """select user_id, doc_id as item, met[1] as ts_ms, met[2] as event_id,
    cast(row_number() over (partition by user_id order by met desc, doc_id) as integer) as place from latest qualify place<=12""",
)
def stream_recent_views(spark: SparkSession, folder: str) -> DataFrame:
    return finished_lists(history.live_views(stream_view(spark, folder, "user_views")))


@query(
    "stream_recent_searches",
    covers="T6 R11",
    sql=with_views("search_history", extra=r"""
    shown as (select user_id, trim(regexp_replace(raw_query,'\s+',' ','g')) as query, timestamp_ms, event_id from search_history),
    latest as (select user_id, lower(query) as k, max((timestamp_ms, event_id, query)) as met from shown where query<>'' group by all)""")
    + """select user_id, met[3] as item, met[1] as ts_ms, met[2] as event_id,
    cast(row_number() over (partition by user_id order by met desc) as integer) as place from latest qualify place<=8""",
)
def stream_recent_searches(spark: SparkSession, folder: str) -> DataFrame:
    return finished_lists(history.live_searches(stream_view(spark, folder, "search_history")))
