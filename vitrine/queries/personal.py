"""Per-user history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.fixtures import view, with_views
from vitrine.operators import history
from vitrine.plans.search_job import personal_rails
from vitrine.queries.registry import query

VIEWS = """
latest as (select user_id, doc_id, max((ts_ms, event_id)) as met from user_views group by all),
recent as (select user_id, doc_id, met[1] as ts_ms, met[2] as event_id,
           row_number() over (partition by user_id order by met desc, doc_id) as place from latest)
"""


@query(
    "recent_views",
    covers="R10",
    sql=with_views("user_views", extra=VIEWS) + "select * from recent where place<=12",
)
def recent_views(spark: SparkSession, folder: str) -> DataFrame:
    found = history.recent_views(view(spark, folder, "user_views"))
    return found.withColumn("place", F.col("place").cast("long"))


@query(
    "recent_searches",
    covers="R11",
    sql=with_views("search_history", extra=r"""
    shown as (select user_id, trim(regexp_replace(raw_query,'\s+',' ','g')) as query, timestamp_ms, event_id from search_history),
    latest as (select user_id, lower(query) as k, max((timestamp_ms, event_id, query)) as met from shown where query<>'' group by all)""")
    + """select user_id, met[3] as query, met[1] as ts_ms, met[2] as event_id,
    row_number() over (partition by user_id order by met desc) as place from latest qualify place<=8""",
)
def recent_searches(spark: SparkSession, folder: str) -> DataFrame:
    found = history.recent_searches(view(spark, folder, "search_history"))
    return found.withColumn("place", F.col("place").cast("long"))


RAILS_SQL = with_views("products", "user_views", extra=VIEWS + """,
    seeds as (select user_id as request_id, place-1 as leg, doc_id as seed_id from recent where place<=6),
    legs as (select * from seeds where request_id in (select request_id from seeds group by request_id having count(*)>=2)),
    wanted as (select id, vector from products where id in (select seed_id from legs)),
    pairs as (select r.id as seed_id, d.id, round(list_cosine_distance(cast(r.vector as double[]), cast(d.vector as double[])),6)+0.0 as dist
              from wanted r, products d where r.id<>d.id),
    hits as (select *, row_number() over (partition by seed_id order by dist, id)-1 as place from pairs qualify place<8),
    fused as (select request_id, id, round(sum(1.0/(61+place)),12) as score, min((leg, place)) as met from legs join hits using (seed_id)
              where not exists (select 1 from legs o where o.request_id=legs.request_id and o.seed_id=hits.id) group by request_id, id)""") + """
select request_id as user_id, id, round(score,9) as score, row_number() over (partition by request_id order by score desc, met) as rank
    from fused qualify rank<=8"""


def rails(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    docs, views = view(spark, folder, "products"), view(spark, folder, "user_views")
    return personal_rails(docs, views, **options).select(
        F.col("request_id").alias("user_id"),
        "id",
        F.round("score", 9).alias("score"),
        F.col("rank").cast("long").alias("rank"),
    )


@query("personal_rails", covers="R12 R10 R3", sql=RAILS_SQL)
def personal_rails_query(spark: SparkSession, folder: str) -> DataFrame:
    return rails(spark, folder)


@query("personal_rails_cells", covers="R12 R4", sql=RAILS_SQL)
def personal_rails_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The same with seeds taken as too many to broadcast."""
    return rails(spark, folder, broadcast_limit=0)
