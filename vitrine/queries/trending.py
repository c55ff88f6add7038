"""Trending queries and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.fixtures import table, view, with_views
from vitrine.functions import gain
from vitrine.functions.text import normalize_query
from vitrine.operators import tables, trending
from vitrine.plans.trending_job import trending_tick
from vitrine.queries.registry import query
from vitrine.sources import events

SOURCE, JOB = "products", "trending-reduce"


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Search history with its tag as a list."""
    return view(spark, folder, "search_history").withColumn("tags", F.array("page_tag"))


def searches(spark: SparkSession, folder: str) -> DataFrame:
    return events.read_searches(history(spark, folder))


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "clickstream")


def last_search_ms(spark: SparkSession, folder: str) -> int:
    return history(spark, folder).agg(F.max("timestamp_ms")).first()[0]


# --- SQL parts ---

NORMALIZED = "replace(lower(trim(regexp_replace(raw_query,'\\s+',' ','g'))),'ß','ss')"

KEYED = f"""
keyed as (select event_id, trace_id, top_result_ids, timestamp_ms, {NORMALIZED} as query
          from search_history
          where page_tag='page:first' and length({NORMALIZED}) between 1 and 160)
"""

QUALITY = """
listed as (select event_id, query, trace_id, unnest(top_result_ids) as doc_id,
                  unnest(range(len(top_result_ids))) as pos from keyed),
placed as (select event_id, query, trace_id, doc_id, max(pos) as pos from listed group by all),
per_search as (select placed.event_id, query, sum(1.0/log2(pos+2)) as dcg, count(*) as n
               from placed join clickstream using (trace_id, doc_id) group by placed.event_id, query),
ideal as (select n, (select sum(1.0/log2(i+2)) from unnest(range(n)) t(i)) as best
          from (select distinct n from per_search)),
ndcgs as (select event_id, query, dcg/best as ndcg from per_search join ideal using (n)),
scored as (select k.query, count(*) as cnt, avg(coalesce(ndcg,0)) as ndcg
           from keyed k left join ndcgs q on k.event_id=q.event_id group by k.query having count(*)>=2)
"""

SAMPLES = """
shown as (select query, timestamp_ms, event_id, unnest(top_result_ids) as doc_id,
                 unnest(range(len(top_result_ids))) as pos from keyed),
firsts as (select query, doc_id, min((timestamp_ms, event_id, pos)) as met from shown group by query, doc_id),
samples as (select query, string_agg(doc_id, ',' order by met) as sample
            from (select *, row_number() over (partition by query order by met) as rn from firsts)
            where rn<=5 group by query)
"""

FREQUENCY_SQL = with_views(
    "search_history",
    extra=f"{KEYED}, {SAMPLES}, counts as (select query, count(*) as cnt from keyed group by query having count(*)>=2)",
) + """
select query, cnt as "count", cast(cnt as double) as score, cast(0 as double) as ndcg, sample
from counts join samples using (query) order by cnt desc, query limit 12
"""

QUALITY_SELECT = """
select query, cnt as "count", round(cnt*(1+1.0*ndcg),6) as score, round(ndcg,6) as ndcg, sample
from scored join samples using (query)
"""


def shown(entries: DataFrame) -> DataFrame:
    """Entries in a form that is easy to compare."""
    return entries.select(
        "query",
        "count",
        F.round("score", 6).alias("score"),
        F.round("ndcg", 6).alias("ndcg"),
        F.array_join("sample_top_ids", ",").alias("sample"),
    )


@query("trending_frequency", covers="A1 A4", sql=FREQUENCY_SQL)
def trending_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return shown(trending.trending(searches(spark, folder)))


@query(
    "trending_quality",
    covers="A2 A3 A4 J3",
    sql=with_views("search_history", "clickstream", extra=f"{KEYED}, {QUALITY}, {SAMPLES}")
    + QUALITY_SELECT
    + 'order by cnt*(1+1.0*ndcg) desc, query limit 12',
)
def trending_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = searches(spark, folder)
    return shown(trending.trending(found, clicks(spark, folder), quality_weight=1.0))


@query(
    "trending_all_queries",
    covers="A2 A3 A4 J3",
    sql=with_views("search_history", "clickstream", extra=f"{KEYED}, {QUALITY}, {SAMPLES}")
    + QUALITY_SELECT,
)
def trending_all_queries(spark: SparkSession, folder: str) -> DataFrame:
    found = searches(spark, folder)
    return shown(
        trending.trending(found, clicks(spark, folder), quality_weight=1.0, top_n=None)
    )


@query(
    "click_attribution",
    covers="J3",
    sql=with_views("search_history", "clickstream", extra=KEYED)
    + """, listed as (select event_id, query, trace_id, unnest(top_result_ids) as doc_id,
                  unnest(range(len(top_result_ids))) as pos from keyed),
    placed as (select event_id, query, trace_id, doc_id, max(pos) as pos from listed group by all)
    select query, trace_id, doc_id, pos as "rank", count(*) as clicks
    from placed join clickstream using (trace_id, doc_id) group by all""",
)
def click_attribution(spark: SparkSession, folder: str) -> DataFrame:
    keyed = trending.keyed_searches(searches(spark, folder))
    ranked = trending.ranked_clicks(trending.search_groups(keyed), clicks(spark, folder))
    return ranked.groupBy("query", "trace_id", "doc_id", F.col("rank").cast("long").alias("rank")).agg(
        F.sum(F.col("searches") * F.col("clicks")).alias("clicks")
    )


@query(
    "ideal_gains",
    covers="A3",
    sql="""with counts as (select event_type, count(*) as clicks from events group by all
      union all select 'all', count(*) from events union all select 'lines', count(*) from lineitem),
    sums as (select event_type, clicks, unnest(range(clicks)) as i from counts)
    select event_type, clicks, round(sum(1.0/log2(i+2)), 4) as ideal from sums group by all""",
)
def ideal_gains(spark: SparkSession, folder: str) -> DataFrame:
    """Best gain of as many clicks as a table has rows, far beyond a single list."""
    log = table(spark, folder, "events")
    counts = (
        log.groupBy("event_type").agg(F.count("*").alias("clicks"))
        .unionByName(log.agg(F.lit("all").alias("event_type"), F.count("*").alias("clicks")))
        .unionByName(table(spark, folder, "lineitem").agg(F.lit("lines").alias("event_type"), F.count("*").alias("clicks")))
    )
    return counts.withColumn("ideal", F.round(gain.idcg(F.col("clicks")), 4))


@query(
    "search_gain",
    covers="A3",
    sql=with_views("search_history", extra=KEYED)
    + """, listed as (select event_id, unnest(range(len(top_result_ids))) as pos,
                             unnest(top_result_ids) as doc_id from keyed),
    -- every listed document counts as clicked when its number is even
    hit as (select event_id, pos from listed where cast(substr(doc_id,2) as bigint)%2=0),
    sums as (select event_id, sum(1.0/log2(pos+2)) as dcg, count(*) as n from hit group by event_id)
    select event_id, round(coalesce(dcg,0),6) as dcg, coalesce(n,0) as clicks,
           round(coalesce(dcg/(select sum(1.0/log2(i+2)) from unnest(range(n)) t(i)),0),6) as ndcg
    from keyed left join sums using (event_id)""",
)
def search_gain(spark: SparkSession, folder: str) -> DataFrame:
    keyed = trending.keyed_searches(searches(spark, folder))
    ids = F.col("top_result_ids")
    # A click on every even-numbered result, so that all positions are exercised.
    spots = F.filter(
        F.transform(
            ids,
            lambda d, i: F.when(F.substring(d, 2, 20).cast("long") % 2 == 0, i).otherwise(-1),
        ),
        lambda r: r >= 0,
    )
    return keyed.select("event_id", spots.alias("ranks")).select(
        "event_id",
        F.round(gain.dcg(F.col("ranks")), 6).alias("dcg"),
        F.size("ranks").cast("long").alias("clicks"),
        F.round(gain.ndcg(F.col("ranks")), 6).alias("ndcg"),
    )


@query(
    "query_sample_ids",
    covers="A4",
    sql=with_views("search_history", extra=f"{KEYED}, {SAMPLES}") + "select query, sample from samples",
)
def query_sample_ids(spark: SparkSession, folder: str) -> DataFrame:
    groups = trending.search_groups(trending.keyed_searches(searches(spark, folder)))
    return trending.sample_ids(groups).select(
        "query", F.array_join("sample_top_ids", ",").alias("sample")
    )


@query(
    "normalized_queries",
    covers="P15",
    sql=with_views("search_history")
    + f"""select raw_query, {NORMALIZED} as query, count(*) as n from search_history group by all
    union all
    select text, case when length(q) between 1 and 160 then q end, count(*) from (
        select text, replace(lower(trim(regexp_replace(text,'\\s+',' ','g'))),'ß','ss') as q from documents)
    group by all""",
)
def normalized_queries(spark: SparkSession, folder: str) -> DataFrame:
    from vitrine.fixtures import table

    raw = view(spark, folder, "search_history").select("raw_query").unionAll(
        table(spark, folder, "documents").select("text")
    )
    return raw.groupBy("raw_query", normalize_query(F.col("raw_query")).alias("query")).agg(
        F.count(F.lit(1)).alias("n")
    )


DAY_WINDOW = """
bounds as (select max(timestamp_ms)//1000*1000 as hi from search_history)
"""


@query(
    "search_window",
    covers="S4 P12",
    sql=with_views("search_history", extra=DAY_WINDOW)
    + """select event_id, trace_id, raw_query, len(top_result_ids) as results, timestamp_ms
    from search_history, bounds where page_tag='page:first' and timestamp_ms between hi-86400000 and hi""",
)
def search_window(spark: SparkSession, folder: str) -> DataFrame:
    lo, hi = events.window_bounds_ms(last_search_ms(spark, folder), 24)
    found = events.read_searches(history(spark, folder), lo, hi)
    return found.select(
        "event_id",
        "trace_id",
        "raw_query",
        F.size("top_result_ids").cast("long").alias("results"),
        "timestamp_ms",
    )


@query(
    "attributed_clicks",
    covers="S5",
    sql=with_views("search_history", "clickstream")
    + """select event_id, trace_id, doc_id, timestamp_ms from clickstream
    where trace_id in (select trace_id from search_history where page_tag='page:first')""",
)
def attributed_clicks(spark: SparkSession, folder: str) -> DataFrame:
    found = events.read_clicks(clicks(spark, folder), searches(spark, folder))
    return found.select("event_id", "trace_id", "doc_id", "timestamp_ms")


TICK = f"""
{DAY_WINDOW},
windowed as (select s.* from search_history s, bounds
             where page_tag='page:first' and timestamp_ms between hi-86400000 and hi),
keyed as (select event_id, trace_id, top_result_ids, timestamp_ms, {NORMALIZED} as query
          from windowed where length({NORMALIZED}) between 1 and 160),
inside as (select c.* from clickstream c, bounds where c.timestamp_ms between hi-86400000 and hi),
listed as (select event_id, query, trace_id, unnest(top_result_ids) as doc_id,
                  unnest(range(len(top_result_ids))) as pos from keyed),
placed as (select event_id, query, trace_id, doc_id, max(pos) as pos from listed group by all),
per_search as (select placed.event_id, query, sum(1.0/log2(pos+2)) as dcg, count(*) as n
               from placed join inside using (trace_id, doc_id) group by placed.event_id, query),
ideal as (select n, (select sum(1.0/log2(i+2)) from unnest(range(n)) t(i)) as best
          from (select distinct n from per_search)),
ndcgs as (select event_id, dcg/best as ndcg from per_search join ideal using (n)),
scored as (select k.query, count(*) as cnt, avg(coalesce(ndcg,0)) as ndcg
           from keyed k left join ndcgs q on k.event_id=q.event_id group by k.query having count(*)>=1),
top as (select *, cnt*(1+1.0*ndcg) as score from scored order by score desc, query limit 12)
"""


@query(
    "trending_tick_rows",
    covers="K7 U5 A1 A2 S4 S5",
    sql=with_views("search_history", "clickstream", extra=TICK)
    + """select 'trend:'||substr(sha256(query),1,16) as id, query, cnt as "count", round(score,6) as score,
    round(ndcg,6) as ndcg, (select max(timestamp_ms) from search_history) as as_of,
    'products' as derived_from, 'trending-reduce' as derived_by from top""",
)
def trending_tick_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = trending_tick(
        history(spark, folder),
        clicks(spark, folder),
        last_search_ms(spark, folder),
        SOURCE,
        JOB,
        quality_weight=1.0,
        min_count=1,
    )
    return rows.select(
        "id",
        "query",
        "count",
        F.round("score", 6).alias("score"),
        F.round("ndcg", 6).alias("ndcg"),
        "as_of",
        F.col("_derived_from").alias("derived_from"),
        F.col("_derived_by").alias("derived_by"),
    )


@query(
    "trending_upsert_read",
    covers="K1 K7 R8",
    sql=with_views("search_history", extra=f"""{KEYED},
    by_day as (select query, trace_id like '%01' or trace_id like '%11' or trace_id like '%21' as early from keyed),
    old as (select query, count(*)*10 as score from by_day where early group by query),
    new as (select query, count(*) as score from by_day where not early group by query having count(*)>=2),
    merged as (select query, cast(score as double) as score from new
               union all select query, cast(score as double) from old where query not in (select query from new))""")
    + """select query, score, 'frequency' as mode from merged order by score desc, query limit 50""",
)
def trending_upsert_read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of an earlier tick survive unless the later tick rewrites them."""
    found = searches(spark, folder)
    early = F.col("trace_id").rlike("[012]1$") & ~F.col("trace_id").rlike("31$")
    old = trending.trending(found.filter(early), min_count=1, top_n=None).withColumn(
        "score", F.col("score") * 10
    )
    new = trending.trending(found.filter(~early), min_count=2, top_n=None)
    stored = tables.upsert(
        trending.trending_rows(old, 1, SOURCE, JOB), trending.trending_rows(new, 2, SOURCE, JOB)
    )
    return trending.read_trending(stored, 50).select("query", "score", "mode")
