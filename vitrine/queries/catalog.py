"""Drop, facet, paging and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.fixtures import table, view, with_views
from vitrine.operators import drops, facets, hits, pipeline_status, products, tables
from vitrine.queries.registry import query
from vitrine.sources import scans


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "products")


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "checkpoints")


def order_days(spark: SparkSession, folder: str) -> DataFrame:
    """One checkpoint per day with orders, closed by the last order of the day."""
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return (
        table(spark, folder, "orders")
        .groupBy(F.to_date("o_orderdate").alias("day"))
        .agg(F.max(ms).alias("watermark_ms"), F.count(F.lit(1)).alias("row_count"))
        .select(
            F.concat(F.lit("catalog-"), F.date_format("day", "yyyy-MM-dd")).alias("label"),
            "watermark_ms",
            "row_count",
        )
    )


ORDER_DAYS = """
order_days as (select 'catalog-'||strftime(o_orderdate,'%Y-%m-%d') as label,
    max(epoch_us(o_orderdate)//1000) as watermark_ms, count(*) as row_count
    from orders group by label)
"""


@query(
    "checkpoint_windows",
    covers="J5",
    sql=f"with {ORDER_DAYS}"
    + """, placed as (select label, watermark_ms as hi, lead(watermark_ms,1,0) over (order by watermark_ms desc) as lo,
    row_number() over (order by watermark_ms desc) as n from order_days)
    select label, lo, hi from placed where n<=100""",
)
def checkpoint_windows(spark: SparkSession, folder: str) -> DataFrame:
    return drops.checkpoint_windows(order_days(spark, folder))


@query(
    "checkpoint_windows_all",
    covers="J5",
    sql=f"with {ORDER_DAYS}"
    + "select label, lead(watermark_ms,1,0) over (order by watermark_ms desc) as lo, watermark_ms as hi from order_days",
)
def checkpoint_windows_all(spark: SparkSession, folder: str) -> DataFrame:
    return drops.checkpoint_windows(order_days(spark, folder), lookup=None)


@query(
    "label_resolution",
    covers="J5",
    sql=f"with {ORDER_DAYS}"
    + """, windows as (select label, watermark_ms as hi, lead(watermark_ms,1,0) over (order by watermark_ms desc) as lo,
      row_number() over (order by watermark_ms desc) as n from order_days),
    asked as (select distinct 'catalog-'||strftime(l_shipdate,'%Y-%m-%d') as label from lineitem)
    select label, lo, hi, hi is not null as known from asked left join (select * from windows where n<=100) using (label)""",
)
def label_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Ship days as labels; those without a recent checkpoint are unknown."""
    asked = (
        table(spark, folder, "lineitem")
        .select(F.concat(F.lit("catalog-"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("label"))
        .distinct()
    )
    return drops.resolve_labels(asked, order_days(spark, folder)).select("label", "lo", "hi", "known")


MEMBERS = """
windows as (select label, watermark_ms as hi, lead(watermark_ms,1,0) over (order by watermark_ms desc) as lo from checkpoints),
members as (select p.*, label from products p left join windows on upserted_at>lo and upserted_at<=hi)
"""


@query(
    "drop_membership",
    covers="J6",
    sql=with_views("checkpoints", extra=MEMBERS) + "select id, upserted_at, label from members",
)
def drop_membership(spark: SparkSession, folder: str) -> DataFrame:
    found = drops.drop_membership(stored(spark, folder), checkpoints(spark, folder))
    return found.select("id", "upserted_at", "label")


SHIPPED_SQL = f"with {ORDER_DAYS}" + """, windows as (select label, watermark_ms as hi,
      lead(watermark_ms,1,0) over (order by watermark_ms desc) as lo from order_days)
    select label, count(*) as rows, count(distinct l_orderkey) as orders from lineitem
    left join windows on epoch_us(l_shipdate)//1000>lo and epoch_us(l_shipdate)//1000<=hi group by label"""


def shipped(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("at")
    )
    found = drops.drop_membership(lines, order_days(spark, folder), "at", **options)
    return found.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("l_orderkey").alias("orders")
    )


@query("shipments_by_drop", covers="J6", sql=SHIPPED_SQL)
def shipments_by_drop(spark: SparkSession, folder: str) -> DataFrame:
    """All order lines against one drop per order day."""
    return shipped(spark, folder)


@query("shipments_by_drop_shuffled", covers="J6", sql=SHIPPED_SQL)
def shipments_by_drop_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a drop list taken as too long to broadcast."""
    return shipped(spark, folder, broadcast_limit=0)


@query(
    "drop_ledger",
    covers="A12",
    sql=f"with {ORDER_DAYS}"
    + """select label as run_id, row_count as product_count, watermark_ms as stable_as_of
    from order_days order by watermark_ms desc limit 7""",
)
def drop_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return drops.drop_ledger(order_days(spark, folder))


@query(
    "recounted_ledger",
    covers="A12 J6",
    sql=with_views("checkpoints", extra=MEMBERS)
    + """select c.label as run_id, row_count as product_count, coalesce(n,0) as found_count, watermark_ms as stable_as_of
    from checkpoints c left join (select label, count(*) as n from members group by label) m using (label)""",
)
def recounted_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return drops.recounted_ledger(stored(spark, folder), checkpoints(spark, folder))


@query(
    "refresh_cursor",
    covers="A10",
    sql=f"with {ORDER_DAYS}" + """select cast(sum(greatest(case when watermark_ms//86400000%9=0 then -1 else row_count end,0)) as bigint) as row_cursor
    from order_days""",
)
def refresh_cursor(spark: SparkSession, folder: str) -> DataFrame:
    """Every ninth day reports an unknown count."""
    day = F.expr("watermark_ms div 86400000")
    days = order_days(spark, folder).withColumn(
        "row_count", F.when(day % 9 == 0, F.lit(-1)).otherwise(F.col("row_count"))
    )
    return pipeline_status.refresh_cursor(days)


@query(
    "facet_snapshot",
    covers="A5",
    sql=with_views("products", extra="""long as (unpivot (select category, title, avg_rating_txt, id from products)
        on category, title, avg_rating_txt, id into name field value value),
    counts as (select field, value, count(*) as doc_count from long group by all)""")
    + "select * from counts where field in (select field from counts group by field having count(*)<=10000)",
)
def facet_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    fields = ["category", "title", "avg_rating_txt", "id"]
    return facets.facet_snapshot(stored(spark, folder), fields, max_distinct=10000)


@query(
    "facet_field_sizes",
    covers="A5",
    sql=with_views("products")
    + """select unnest(['category','title','id']) as field, unnest([count(distinct category), count(distinct title), count(distinct id)]) as distinct_values,
    unnest([count(distinct category)>10000, count(distinct title)>10000, count(distinct id)>10000]) as skipped from products""",
)
def facet_field_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return facets.field_sizes(stored(spark, folder), ["category", "title", "id"], 10000)


@query(
    "table_metadata",
    covers="A6 A8",
    sql=with_views("products", "stage_events", extra="""last as (select pipeline_id, doc_id, arg_max(stage,(ts_ms,event_id)) as stage from stage_events group by all)""")
    + """select count(*) as row_count, max(upserted_at) as stable_as_of,
    (select bool_and(stage='indexed') from last) as is_stable from products""",
)
def table_metadata(spark: SparkSession, folder: str) -> DataFrame:
    events = view(spark, folder, "stage_events")
    status = pipeline_status.status_of(
        pipeline_status.stage_counts(events), events.select("pipeline_id")
    )
    return facets.table_metadata(stored(spark, folder), pipeline_status.stability(status))


@query(
    "browse_page",
    covers="R13 P12",
    sql=with_views("checkpoints", extra=MEMBERS + """,
    newest as (select label from checkpoints order by watermark_ms desc limit 1),
    page as (select id, title, row_number() over (order by id) as n from members where label=(select label from newest)
             and id>(select min(id) from members where label=(select label from newest)))""")
    + "select id, title, case when n=7 then 'id:'||id end as next_cursor from page where n<=7",
)
def browse_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of the newest drop, after its first id."""
    newest = drops.checkpoint_windows(checkpoints(spark, folder)).orderBy(F.col("hi").desc()).first()
    window = (newest["lo"], newest["hi"])
    first = drops.browse_page(stored(spark, folder), window, 1).first()
    page = drops.browse_page(stored(spark, folder), window, 7, first["next_cursor"])
    return page.select("id", "title", "next_cursor")


@query(
    "browse_first_pages",
    covers="R13 J6",
    sql=with_views("checkpoints", extra=MEMBERS + """,
    page as (select label, id, row_number() over (partition by label order by id) as n,
             count(*) over (partition by label) as total from members where label is not null)""")
    + "select label, id, n as place, case when n=8 and total>8 then 'id:'||id end as next_cursor from page where n<=8",
)
def browse_first_pages(spark: SparkSession, folder: str) -> DataFrame:
    """First page of every drop at once."""
    marks = checkpoints(spark, folder)
    members = drops.drop_membership(stored(spark, folder), marks)
    requests = marks.select(
        F.col("label").alias("request_id"), "label", F.lit(None).cast("string").alias("after_id")
    )
    pages = drops.browse_pages(members, requests, 8)
    return pages.select("label", "id", F.col("place").cast("long").alias("place"), "next_cursor")


@query(
    "offset_cursors",
    covers="R15",
    sql="""with c as (select event_id, case event_type when 'view' then 'scan:s'||user_id||':'||event_id
        when 'click' then cast(event_id as varchar) when 'error' then '-'||(event_id+1) when 'signup' then 'scan::5' else null end as cursor from events)
    select event_id, case when cursor like 'scan:s%' then regexp_extract(cursor,'scan:(s[0-9]+):',1) end as scan_id,
    case when cursor is null then 0 when cursor like 'scan:s%' or cursor not like '%:%' and cursor not like '-%' then event_id end as "offset",
    cursor is null or cursor like 'scan:s%' or (cursor not like '%:%' and cursor not like '-%') as valid,
    case when cursor like 'scan:s%' and event_id+10<9000 then 'scan:'||regexp_extract(cursor,'scan:(s[0-9]+):',1)||':'||(event_id+10) end as next_cursor from c""",
)
def offset_cursors(spark: SparkSession, folder: str) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id")
    cursor = (
        F.when(kind == "view", F.concat(F.lit("scan:s"), F.col("user_id"), F.lit(":"), number))
        .when(kind == "click", number.cast("string"))
        .when(kind == "error", F.concat(F.lit("-"), number + 1))
        .when(kind == "signup", F.lit("scan::5"))
    )
    asked = table(spark, folder, "events").select("event_id", cursor.alias("cursor"))
    parsed = drops.offset_cursors(asked)
    following = drops.next_scan_cursor(F.col("scan_id"), F.col("offset"), F.lit(10), F.lit(9000))
    return parsed.select("event_id", "scan_id", "offset", "valid", following.alias("next_cursor"))


@query(
    "rotating_slice",
    covers="R19",
    sql=with_views("products", extra="""seed as (select list_reduce(list_prepend(0, [ascii(c) for c in string_split('catalog-2024-06-09','')]),
        lambda h, c: (h*31 + c)%997) as s),
    placed as (select id, row_number() over (order by id)-1 as n, count(*) over () as total from products)""")
    + """select id, ((n-s%total)%total+total)%total as place from placed, seed where ((n-s%total)%total+total)%total<total//3""",
)
def rotating_slice(spark: SparkSession, folder: str) -> DataFrame:
    docs = stored(spark, folder).select("id")
    return drops.rotating_slice(docs, "catalog-2024-06-09", docs.count() // 3).select("id", "place")


@query(
    "id_scan",
    covers="S8",
    sql="""select 'O'||o_orderkey as id, row_number() over (order by 'O'||o_orderkey)-1 as position from orders""",
)
def id_scan(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("id"))
    return scans.numbered_ids(ids).select("id", "position")


@query(
    "id_scan_page",
    covers="S8",
    sql="""with placed as (select 'O'||o_orderkey as id, row_number() over (order by 'O'||o_orderkey)-1 as position, count(*) over () as total from orders)
    select id, position, total//2+total//4 as next_offset, total from placed where position>=total//2 and position<total//2+total//4""",
)
def id_scan_page(spark: SparkSession, folder: str) -> DataFrame:
    """Resumed at the middle, a quarter of all ids long."""
    ids = table(spark, folder, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("id"))
    numbered = scans.numbered_ids(ids)
    total = numbered.count()
    return scans.scan_page(numbered, total // 2, total // 4)


@query(
    "batch_fetch",
    covers="J2 P9",
    sql=with_views("products", "clickstream", extra="wanted as (select distinct doc_id as id from clickstream union select distinct trace_id from clickstream)")
    + """select w.id, title, category, p.id is not null as found from wanted w left join products p on p.id=w.id""",
)
def batch_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """Clicked ids, padded and repeated, and trace ids that no document has."""
    clicked = view(spark, folder, "clickstream")
    ids = clicked.select(F.concat(F.lit(" "), "doc_id", F.lit("  ")).alias("id")).unionAll(
        clicked.select(F.col("trace_id").alias("id"))
    )
    return tables.fetch_by_ids(stored(spark, folder), ids, ["title", "category"]).select(
        "id", "title", "category", "found"
    )


@query(
    "product_cards",
    covers="P10",
    sql=with_views("products")
    + """select id as asin, coalesce(title,'') as title, coalesce(description,'') as description, category,
    coalesce(image_url,'') as image_url, image_blob, cast(null as double) as price,
    cast(avg_rating_txt as double) as rating, cast(rating_cnt_txt as double) as rating_count from products""",
)
def product_cards(spark: SparkSession, folder: str) -> DataFrame:
    return products.cards(stored(spark, folder).drop("vector"))


@query(
    "hit_shapes",
    covers="P14",
    sql=with_views("products")
    + """select id, upserted_at/1000.0 as dist, 'category='||category||' title='||title as attributes from products
    union all select id, case when category='cat1' then null else price end, 'title='||title from products""",
)
def hit_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Flat rows with a doubtful ``dist`` next to ``$dist``, and structured results."""
    docs = stored(spark, folder)
    rows = docs.select(
        F.to_json(
            F.struct(
                "id",
                (F.col("upserted_at") / 1000.0).alias("$dist"),
                F.lit("x").alias("dist"),
                F.lit(1).alias("$rank"),
                "title",
                "category",
            )
        ).alias("row")
    )
    results = docs.select(
        "id",
        F.when(F.col("category") != "cat1", F.col("price")).alias("dist"),
        F.create_map(F.lit("title"), "title").alias("attributes"),
    )
    entries = F.array_sort(F.map_entries("attributes"))
    shown = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    return hits.all_hits(rows, results).select("id", "dist", shown.alias("attributes"))


@query(
    "browse_following_pages",
    covers="R13 J6",
    sql=with_views("checkpoints", "user_views", extra=MEMBERS + """,
    asked as (select cast(user_id as varchar)||'/'||v.doc_id as request_id, m.label, v.doc_id as after_id
              from (select distinct user_id, doc_id from user_views) v join members m on m.id=v.doc_id where m.label is not null),
    placed as (select request_id, a.label, m.id, row_number() over (partition by request_id order by m.id) as n,
               count(*) over (partition by request_id) as total from asked a join members m on m.label=a.label and m.id>a.after_id)""")
    + "select request_id, label, id, cast(n as integer) as place, case when n=5 and total>5 then 'id:'||id end as next_cursor from placed where n<=5",
)
def browse_following_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each user pages on from each item viewed, within its drop."""
    members = drops.drop_membership(stored(spark, folder), checkpoints(spark, folder)).select("id", "label")
    views = view(spark, folder, "user_views").select("user_id", F.col("doc_id").alias("id")).distinct()
    requests = views.join(members, "id").filter(F.col("label").isNotNull()).select(
        F.concat_ws("/", F.col("user_id").cast("string"), "id").alias("request_id"),
        "label",
        F.col("id").alias("after_id"),
    )
    return drops.browse_pages(members, requests, 5)
