"""Ingest queries: normalising, staging, slicing and writing products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.fixtures import table, view, with_views
from vitrine.functions import coerce as C
from vitrine.functions import text as X
from vitrine.operators import embedding, products, slices, tables
from vitrine.queries.registry import query
from vitrine.session import settle
from vitrine.sources import catalog, events
from vitrine.sources.bucketed import BucketedTable
from vitrine.sources.versioned import VersionedTable


def raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The raw catalog with each row as one VARIANT, images as a list of two."""
    rows = view(spark, folder, "raw_catalog")
    row = F.struct(
        "parent_asin",
        "asin",
        "title",
        "description",
        "features",
        "price",
        "average_rating",
        "rating_number",
        F.array(
            F.struct(F.lit(None).cast("string").alias("hi_res"), F.col("large")),
            F.struct("hi_res", F.lit(None).cast("string").alias("large")),
        ).alias("images"),
    )
    return rows.select("row_no", "category", F.to_variant_object(row).alias("v"))


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    return products.normalize_products(raw_rows(spark, folder), keep=["row_no"])


def text_list(name: str) -> str:
    """First three non-blank parts of a DuckDB list, joined."""
    return (
        f"nullif(array_to_string([trim(x) for x in {name} if trim(x)<>''][1:3],' '),'')"
    )


NORMALIZED = f"""
picked as (select *, coalesce(nullif(parent_asin,''), asin) as a, coalesce(hi_res, large) as image_url,
                  nullif(trim(title),'') as t,
                  case when len(description)>0 then {text_list('description')} else {text_list('features')} end as d
           from raw_catalog),
normalized as (select row_no, a as asin, category, image_url, t as title, d as description,
                      try_cast(nullif(nullif(replace(replace(price,'$',''),',',''),''),'None') as double) as price,
                      cast(average_rating as double) as avg_rating,
                      cast(trunc(cast(replace(rating_number,',','') as double)) as bigint) as rating_count
               from picked where a is not null and image_url is not null)
"""


@query(
    "product_normalisation",
    covers="P1 P2 P3 P4 P5",
    sql=with_views("raw_catalog", extra=NORMALIZED) + "select * from normalized",
)
def product_normalisation(spark: SparkSession, folder: str) -> DataFrame:
    return normalized(spark, folder)


@query(
    "number_coercion",
    covers="P2 P3",
    sql=with_views("raw_catalog")
    + """select row_no, try_cast(nullif(replace(replace(price,'$',''),',',''),'None') as double) as price,
    cast(trunc(try_cast(nullif(replace(rating_number,',',''),'None') as double)) as bigint) as rating_count,
    cast(trunc(try_cast(average_rating as double)) as bigint) as whole_rating,
    try_cast(title as double) as not_a_number from raw_catalog""",
)
def number_coercion(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "raw_catalog").select(
        "row_no",
        C.float_from_text("price").alias("price"),
        C.int_from_text("rating_number").alias("rating_count"),
        C.int_from_text("average_rating").alias("whole_rating"),
        C.float_from_text("title").alias("not_a_number"),
    )


@query(
    "text_coercion",
    covers="P4",
    sql=f"""select doc_id, nullif(trim(lang),'') as scalar_text,
    {text_list("string_split(text, chr(10))")} as list_text from documents""",
)
def text_coercion(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    one = F.try_variant_get(F.to_variant_object(F.array("lang")), "$[0]", "variant")
    many = F.to_variant_object(F.split("text", "\n"))
    return docs.select("doc_id", one.alias("one"), many.alias("many")).select(
        "doc_id",
        C.first_text("one").alias("scalar_text"),
        C.first_text("many").alias("list_text"),
    )


@query(
    "image_choice",
    covers="P5",
    sql=with_views("raw_catalog")
    + """select row_no, case row_no%5 when 0 then coalesce(hi_res, large)
      when 1 then coalesce(large, hi_res) when 2 then large when 3 then coalesce(large, 'http://img/late.jpg')
      else coalesce(large, hi_res, 'http://img/late.jpg') end as image_url
    from raw_catalog""",
)
def image_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Images as object list, object of lists, plain text, mixed list and lists in lists by turns."""

    def quoted(c: str) -> Column:
        return F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))

    hi, large = quoted("hi_res"), quoted("large")
    shapes = (
        F.when(
            F.col("row_no") % 5 == 0,
            F.concat(F.lit('[{"large":'), large, F.lit('},{"hi_res":'), hi, F.lit("}]")),
        )
        .when(
            F.col("row_no") % 5 == 1,
            F.concat(F.lit('{"thumb":['), hi, F.lit('],"large":["",'), large, F.lit("]}")),
        )
        .when(F.col("row_no") % 5 == 2, large)
        .when(
            F.col("row_no") % 5 == 3,
            F.concat(F.lit('[null, "", '), large, F.lit(', ["http://img/late.jpg"]]')),
        )
        .otherwise(
            F.concat(
                F.lit('[[[[{"thumb":'), hi, F.lit('},{"large":'), large, F.lit('}]],[""]],"http://img/late.jpg"]')
            )
        )
    )
    rows = view(spark, folder, "raw_catalog").select("row_no", F.parse_json(shapes).alias("images"))
    return rows.select("row_no", C.pick_image_url("images").alias("image_url"))


STAGED = NORMALIZED + """,
seen as (select distinct 'B'||json_extract_string(props,'$.k') as id from events where event_type='view'),
staged as (select asin as id, concat_ws(chr(10), title, description) as text, * exclude (row_no)
           from normalized where asin not in (select id from seen))
"""


def indexed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids taken as already indexed: those that were viewed."""
    viewed = table(spark, folder, "events").filter(F.col("event_type") == "view")
    return viewed.select(
        F.concat(F.lit("B"), F.get_json_object("props", "$.k")).alias("id")
    ).distinct()


def staged(spark: SparkSession, folder: str) -> DataFrame:
    chunks = products.stage_chunks(normalized(spark, folder))
    return tables.skip_existing(chunks, indexed_ids(spark, folder))


@query(
    "staged_chunks",
    covers="K3 J1 P6 P7",
    sql=with_views("raw_catalog", extra=STAGED)
    + """select id, text, asin, category, image_url, title, description, price, avg_rating, rating_count from staged""",
)
def staged_chunks(spark: SparkSession, folder: str) -> DataFrame:
    fields = ("asin", "category", "image_url", "title", "description", "price", "avg_rating", "rating_count")
    return staged(spark, folder).select("id", "text", *[f"metadata.{f}" for f in fields])


@query(
    "sparse_attributes",
    covers="P7",
    sql=with_views("raw_catalog", extra=NORMALIZED)
    + """select asin, (title is not null)::int + (description is not null)::int + (price is not null)::int
    + (avg_rating is not null)::int + (rating_count is not null)::int + 3 as attributes from normalized""",
)
def sparse_attributes(spark: SparkSession, folder: str) -> DataFrame:
    found = normalized(spark, folder)
    # Absent attributes leave no key behind in the JSON form.
    keys = F.json_object_keys(F.to_json(products.sparse_attributes(found)))
    return found.select("asin", F.size(keys).alias("attributes"))


@query(
    "vector_attributes",
    covers="P8",
    sql=with_views("raw_catalog", extra=STAGED)
    + """select id, coalesce(nullif(asin,''), id) as asin, title, category, description, image_url,
    cast(null as varchar) as image_blob, cast(avg_rating as varchar) as avg_rating_txt,
    cast(rating_count as varchar) as rating_cnt_txt from staged""",
)
def vector_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return products.vector_attributes(staged(spark, folder))


CATEGORY_NAMES = """
select row_no as pos, case row_no%4 when 0 then '  '||category when 1 then lower(category)||' '
       when 2 then ' ' else category end as category from raw_catalog
"""


def category_names(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.col("row_no") % 4
    name = F.col("category")
    return view(spark, folder, "raw_catalog").select(
        F.col("row_no").alias("pos"),
        F.when(turn == 0, F.concat(F.lit("  "), name))
        .when(turn == 1, F.concat(F.lower(name), F.lit(" ")))
        .when(turn == 2, F.lit(" "))
        .otherwise(name)
        .alias("category"),
    )


@query(
    "category_dedupe",
    covers="S3",
    sql=with_views("raw_catalog", extra=f"names as ({CATEGORY_NAMES})")
    + """select min(pos) as pos, arg_min(trim(category), pos) as category from names
    where trim(category)<>'' group by lower(trim(category))""",
)
def category_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.distinct_categories(category_names(spark, folder))


@query(
    "category_totals",
    covers="S3",
    sql=with_views("raw_catalog", extra=NORMALIZED)
    + "select category, count(*) as row_count from normalized group by rollup(category)",
)
def category_totals(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.category_counts(normalized(spark, folder))


@query(
    "valid_row_slices",
    covers="R16 R17",
    sql=with_views("raw_catalog", extra=NORMALIZED)
    + """, placed as (select asin, row_no, row_number() over (order by row_no)-1 as ordinal from normalized)
    select asin, ordinal, (ordinal-60)//100 as slice from placed where ordinal>=60""",
)
def valid_row_slices(spark: SparkSession, folder: str) -> DataFrame:
    placed = slices.numbered(settle(normalized(spark, folder)), ["row_no"])
    return slices.assign_slices(placed, 60, 100).select("asin", "ordinal", "slice")


@query(
    "offset_limit_rows",
    covers="R16",
    sql=with_views("raw_catalog", extra=NORMALIZED)
    + """, placed as (select asin, row_number() over (order by row_no)-1 as ordinal,
                      count(*) over () as n from normalized)
    select asin, ordinal from placed where ordinal>=n//4 and ordinal<n//4+n//2""",
)
def offset_limit_rows(spark: SparkSession, folder: str) -> DataFrame:
    placed = slices.numbered(settle(normalized(spark, folder)), ["row_no"])
    total = placed.count()
    return slices.take_slice(placed, total // 4, total // 2).select("asin", "ordinal")


PLANNED = """
wanted as (select category, min(row_no)%50 as row_offset, count(*) as n from normalized group by category),
steps as (select category, row_offset, n, unnest(range(0, n, 30)) as step from wanted),
planned as (select category, row_offset+step as row_offset, least(30, n-step) as row_limit from steps)
"""


def planned(spark: SparkSession, folder: str) -> DataFrame:
    wanted = normalized(spark, folder).groupBy("category").agg(
        (F.min("row_no") % 50).alias("row_offset"), F.count(F.lit(1)).alias("count")
    )
    return slices.plan_slices(wanted, 30)


@query(
    "slice_plan",
    covers="R17",
    sql=with_views("raw_catalog", extra=f"{NORMALIZED}, {PLANNED}")
    + """select category, row_offset, row_limit,
    'index:scheduled:catalog-2024%2F01%3A%20a:'||category||':'||row_offset||':'||row_limit as id from planned""",
)
def slice_plan(spark: SparkSession, folder: str) -> DataFrame:
    return slices.scheduled_ids(planned(spark, folder), F.lit("catalog-2024/01: a"))


@query(
    "slice_plan_round_trip",
    covers="R17",
    sql=with_views("raw_catalog", extra=f"{NORMALIZED}, {PLANNED}")
    + """select 'catalog-2024/01: a' as run_label, category||' & co: 50%' as category, row_offset, row_limit, 'ok' as status
    from planned union all select null, null, null, null, 'invalid' from planned
    union all select null, null, null, null, 'other' from planned""",
)
def slice_plan_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    wild = planned(spark, folder).withColumn("category", F.concat("category", F.lit(" & co: 50%")))
    coded = slices.scheduled_ids(wild, F.lit("catalog-2024/01: a")).select("id")
    broken = coded.select(F.regexp_replace("id", ":[^:]*$", ":x").alias("id"))
    foreign = coded.select(F.concat(F.lit("refresh:"), "id").alias("id"))
    every = coded.unionAll(broken).unionAll(foreign)
    return slices.parse_scheduled_ids(every).select(
        "run_label", "category", "row_offset", "row_limit", "status"
    )


@query(
    "event_times",
    covers="S6",
    sql="""select event_id, case event_id%3 when 0 then epoch_us(ts)//1000 when 1 then epoch_us(ts)//1000 else 0 end as ms
    from events""",
)
def event_times(spark: SparkSession, folder: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    turn = F.col("event_id") % 3
    return table(spark, folder, "events").select(
        "event_id",
        events.event_time_ms(
            F.when(turn == 0, F.expr("unix_micros(cast(ts as timestamp)) div 1000")),
            F.when(turn == 1, micros * 1000 + 999),
        ).alias("ms"),
    )


@query(
    "recorded_searches",
    covers="S7",
    sql=with_views("search_history", extra="""log as (select event_id, raw_query,
        case when user_id%4=0 then 'api' when user_id%4=1 then null else 'storefront' end as surface,
        case when page_tag='page:next' then '5' when event_id%7=0 then '' end as cursor from search_history)""")
    + """select event_id, raw_query, 'app:shop surface:storefront route:search page:first' as tags
    from log where surface='storefront' and coalesce(cursor,'')=''""",
)
def recorded_searches(spark: SparkSession, folder: str) -> DataFrame:
    log = view(spark, folder, "search_history").select(
        "event_id",
        "raw_query",
        F.when(F.col("user_id") % 4 == 0, "api")
        .when(F.col("user_id") % 4 == 1, F.lit(None))
        .otherwise("storefront")
        .alias("surface"),
        F.when(F.col("page_tag") == "page:next", "5")
        .when(F.col("event_id") % 7 == 0, "")
        .alias("cursor"),
    )
    kept = events.recorded_searches(log, "app:shop")
    return kept.select("event_id", "raw_query", F.array_join("tags", " ").alias("tags"))


@query(
    "embedding_triage",
    covers="U4",
    sql=with_views("products", "clickstream", extra="""claims as (select distinct doc_id as id from clickstream
        union select 'X'||trace_id from clickstream),
    errors as (select distinct doc_id as id from clickstream c join products p on p.id=c.doc_id where category='cat3')""")
    + """select c.id, case when e.id is not null then 'retry' when p.id is null or coalesce(image_url,'')='' then 'failed'
    else 'ready' end as outcome from claims c left join products p on p.id=c.id left join errors e on e.id=c.id""",
)
def embedding_triage(spark: SparkSession, folder: str) -> DataFrame:
    stored = view(spark, folder, "products")
    clicked = view(spark, folder, "clickstream")
    unknown = clicked.select(F.concat(F.lit("X"), "trace_id"))
    claims = clicked.select(F.col("doc_id").alias("id")).unionAll(unknown).distinct()
    chunks = stored.select("id", F.struct("image_url").alias("metadata"))
    failed_reads = stored.filter(F.col("category") == "cat3").select("id")
    return embedding.triage(claims, chunks, failed_reads).select("id", "outcome")


@query(
    "embedded_catalog",
    covers="U1 K4 K5 S9",
    sql=with_views("raw_catalog", extra=STAGED)
    + """select id, title, cast(avg_rating as varchar) as avg_rating_txt, 'blob://products/'||sha256(image_url) as image_blob,
    64 as dims, cast(1704067200000 as bigint) as upserted_at from staged""",
)
def embedded_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Every staged product with a vector from its (stand-in) image bytes."""
    from vitrine.operators import blobs

    chunks = settle(staged(spark, folder))
    images = chunks.select("id", F.col("metadata.image_url").cast("binary").alias("content"))
    embedded = settle(embedding.embed_images(images, embedding.hashed_bytes_encoder()))
    stored = blobs.addressed(images, "products")
    empty = chunks.select("id").limit(0)
    rows = embedding.write_vectors(empty, chunks, embedded, stored, 1704067200000)
    return rows.select(
        "id", "title", "avg_rating_txt", "image_blob", F.size("vector").alias("dims"), "upserted_at"
    )


@query(
    "drop_labels",
    covers="P17",
    sql="""select o_orderdate, 'catalog-'||strftime(o_orderdate,'%Y-%m-%d') as label, cast(o_orderdate as date) as day,
    cast(null as date) as other_day,
    case when o_orderkey%3=0 then 'catalog-'||strftime(o_orderdate,'%Y-%m-%d') else o_orderpriority end as resolved,
    count(*) as n from orders group by all""",
)
def drop_labels(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    label = X.drop_label(F.col("o_orderdate"))
    given = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority"))
    return orders.groupBy(
        F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
        label.alias("label"),
        X.drop_date(label).alias("day"),
        X.drop_date(F.concat(label, F.lit("x"))).alias("other_day"),
        X.drop_label_or_default(given, F.col("o_orderdate")).alias("resolved"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rotation_seeds",
    covers="P19",
    sql="""select distinct p_name, cast(list_reduce(list_prepend(0, [ascii(c) for c in string_split(p_name,'')]),
    lambda h, c: (h*31 + c)%997) as integer) as seed from part""",
)
def rotation_seeds(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select("p_name").distinct()
    return names.select("p_name", X.rotation_seed(F.col("p_name")).alias("seed"))


@query(
    "lenient_values",
    covers="P13",
    sql="""select event_id,
    case event_type when 'view' then cast(json_extract_string(props,'$.k') as bigint)
      when 'click' then cast(trunc(value) as bigint)
      when 'error' then cast(json_extract_string(props,'$.k') as bigint) else 0 end as whole,
    round(case event_type when 'view' then cast(json_extract_string(props,'$.k') as double)
      when 'click' then value when 'error' then cast(json_extract_string(props,'$.k') as double) else 0 end,6) as number,
    case event_type when 'signup' then event_type||',b' else '' end as texts from events""",
)
def lenient_values(spark: SparkSession, folder: str) -> DataFrame:
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    body = (
        F.when(kind == "view", k)
        .when(kind == "click", F.col("value").cast("string"))
        .when(kind == "error", F.concat(F.lit('"'), k, F.lit('"')))
        .when(kind == "purchase", F.lit("true"))
        .otherwise(F.concat(F.lit('["'), kind, F.lit('", 7, "b", null]')))
    )
    found = table(spark, folder, "events").select("event_id", F.parse_json(body).alias("v"))
    return found.select(
        "event_id",
        C.lenient_int("v").alias("whole"),
        F.round(C.lenient_float("v"), 6).alias("number"),
        F.array_join(C.text_items("v"), ",").alias("texts"),
    )


@query(
    "keyed_upsert",
    covers="K1",
    sql=with_views("products", "clickstream", extra="""latest as (select doc_id as id, 'clicked' as category, timestamp_ms as upserted_at
        from clickstream qualify row_number() over (partition by doc_id order by timestamp_ms desc, event_id desc)=1)""")
    + """select id, category, upserted_at from latest union all
    select id, category, upserted_at from products where id not in (select id from latest)""",
)
def keyed_upsert(spark: SparkSession, folder: str) -> DataFrame:
    target = view(spark, folder, "products").select("id", "category", "upserted_at")
    rows = view(spark, folder, "clickstream").select(
        F.col("doc_id").alias("id"),
        F.lit("clicked").alias("category"),
        F.col("timestamp_ms").alias("upserted_at"),
        "event_id",
    )
    newest = [F.col("upserted_at").desc(), F.col("event_id").desc()]
    return tables.upsert(target, rows, version=newest).select("id", "category", "upserted_at")


@query(
    "patched_columns",
    covers="K2",
    sql=with_views("products", "clickstream", extra="""refs as (select doc_id as id, 'blob://products/'||sha256(min(trace_id)) as ref
        from clickstream group by doc_id)""")
    + """select p.id, p.title, coalesce(ref, image_blob) as image_blob from products p left join refs r on r.id=p.id""",
)
def patched_columns(spark: SparkSession, folder: str) -> DataFrame:
    patch = (
        view(spark, folder, "clickstream")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(X.blob_ref("products", F.sha2(F.min("trace_id"), 256)).alias("image_blob"))
    )
    docs = view(spark, folder, "products")
    return tables.patch_columns(docs, patch).select("id", "title", "image_blob")


@query(
    "last_write_wins",
    covers="K1 K2 K4 T3",
    sql=with_views("clickstream", extra="""named as (select doc_id as id, event_id, 'click '||event_id as title from clickstream),
    stored as (select id, max_by(title, event_id) as title, arg_min(title, event_id) as image_blob from named group by id)""")
    + "select id, 'all' as category, title, image_blob, cast(2000 as bigint) as upserted_at from stored",
)
def last_write_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated ids of a catalog file, dealt out anew before each step, and repeated patches of them."""
    from vitrine.streaming.runner import scratch_folder

    clicks = view(spark, folder, "clickstream").select("doc_id", "event_id", F.concat(F.lit("click "), "event_id").alias("title"))
    source = scratch_folder(spark, "repeated")
    lines = clicks.select(
        "event_id",
        F.to_json(F.struct(F.col("doc_id").alias("parent_asin"), "title", F.lit("http://img").alias("images"))).alias("value"),
    )
    lines.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(source)
    read = catalog.read_in_order(spark, source).withColumn("category", F.lit("all"))
    valid = settle(products.normalize_products(read, keep=catalog.SOURCE_ORDER)).repartition(5, "title")
    chunks = products.stage_chunks(valid, catalog.SOURCE_ORDER)
    stored = BucketedTable(spark, scratch_folder(spark, "stored"), buckets=16)
    # The first write takes some of the rows, the second one all of them.
    for stamp, rows in ((1000, chunks.filter(F.crc32("metadata.title") % 3 == 0)), (2000, chunks)):
        last = tables.one_per_key(rows.repartition(7), version=tables.last_written(rows))
        stored.upsert(products.vector_attributes(last).withColumn("upserted_at", F.lit(stamp).cast("long")))
    first = clicks.select(F.col("doc_id").alias("id"), F.col("title").alias("image_blob"), "event_id").repartition(5, "title")
    stored.patch(first, version=[F.col("event_id")])
    return stored.read().select("id", "category", "title", "image_blob", "upserted_at")


def written_catalog(spark: SparkSession, folder: str) -> str:
    """The raw catalog written as JSON lines, one file set per category."""
    from vitrine.streaming.runner import scratch_folder

    target = scratch_folder(spark, "catalog")
    rows = raw_rows(spark, folder).select(
        F.concat(F.lit("meta_"), "category", F.lit(".main.jsonl")).alias("file"),
        F.to_json("v").alias("value"),
    )
    rows.write.partitionBy("file").text(target)
    return target


@query(
    "catalog_scan",
    covers="S1 S2 S3",
    sql=with_views("raw_catalog", extra=NORMALIZED)
    + "select asin, category, image_url, title, description, price, avg_rating, rating_count from normalized",
)
def catalog_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All categories read back from JSON lines in one scan and normalised."""
    target = written_catalog(spark, folder)
    names = table(spark, folder, "part").select(F.col("p_type").alias("category")).distinct()
    # A handful of category names; they are paths of one scan.
    wanted = [r["category"] for r in names.collect()]
    rows = catalog.read_categories(spark, target, wanted, layout="file={file}")
    return products.normalize_products(rows)


@query(
    "file_row_slices",
    covers="S1 R16 R17",
    sql=with_views("raw_catalog", extra=NORMALIZED)
    + """, placed as (select asin, row_number() over (order by row_no)-1 as ordinal from normalized)
    select asin, ordinal, (ordinal-60)//100 as slice from placed where ordinal>=60""",
)
def file_row_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Slices of valid rows by their place in JSON-lines files."""
    from vitrine.streaming.runner import scratch_folder

    target = scratch_folder(spark, "ordered")
    rows = raw_rows(spark, folder).repartitionByRange("row_no").sortWithinPartitions("row_no")
    rows.select(F.to_json("v").alias("value")).write.text(target)
    read = catalog.read_in_order(spark, target).withColumn("category", F.lit("all"))
    valid = settle(products.normalize_products(read, keep=catalog.SOURCE_ORDER))
    placed = slices.numbered(valid, catalog.SOURCE_ORDER)
    return slices.assign_slices(placed, 60, 100).select("asin", "ordinal", "slice")


def scratch_tables(spark: SparkSession) -> tuple[BucketedTable, VersionedTable]:
    from vitrine.streaming.runner import scratch_folder

    root = scratch_folder(spark, "refresh")
    return BucketedTable(spark, f"{root}/products", buckets=16), VersionedTable(spark, f"{root}/checkpoints")


@query(
    "refresh_runs",
    covers="T3 T4 A10 R16 J1 K1 K4",
    sql=with_views("raw_catalog", extra=NORMALIZED)
    + """, placed as (select *, row_number() over (order by row_no)-1 as n, count(*) over () as total from normalized)
    select asin as id, category, title, 1000*(1+n//(total//2+1)) as upserted_at,
    'catalog-2024-01-0'||(1+n//(total//2+1)) as label from placed""",
)
def refresh_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Two nightly runs over the whole catalog; the first one is tried twice."""
    from vitrine.operators import drops
    from vitrine.streaming.refresh import refresh_once

    valid = settle(normalized(spark, folder))
    size = valid.count() // 2 + 1
    stored, marks = scratch_tables(spark)
    for run in (1, 1, 2):
        refresh_once(
            valid, ["row_no"], stored, marks, f"catalog-2024-01-0{run}", 1000 * run, size
        )
    members = drops.drop_membership(stored.read(), marks.read())
    return members.select("id", "category", "title", "upserted_at", "label")


@query(
    "refresh_stream",
    covers="T3 T4",
    sql=with_views("raw_catalog", extra=NORMALIZED) + "select asin as id, category, title, cast(1000 as bigint) as upserted_at from normalized",
)
def refresh_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The written catalog drained as a stream of files."""
    from vitrine.streaming.refresh import catalog_stream, run_refresh
    from vitrine.streaming.runner import scratch_folder

    source = catalog_stream(spark, written_catalog(spark, folder) + "/*")
    category = F.regexp_extract(F.input_file_name(), r"meta_([^/]*)\.main\.jsonl", 1)
    stored, marks = scratch_tables(spark)
    run_refresh(
        source.select("*", category.alias("category")),
        stored,
        marks,
        scratch_folder(spark, "progress"),
        lambda batch: f"run-{batch}",
        lambda batch: 1000 * (batch + 1),
    )
    return stored.read().select("id", "category", "title", "upserted_at")


@query(
    "gated_activation",
    covers="T4 A8",
    sql=with_views("stage_events")
    + "select 'second' as label, cast(2000 as bigint) as watermark_ms, count(*) as row_count from stage_events",
)
def gated_activation(spark: SparkSession, folder: str) -> DataFrame:
    """A checkpoint refused while a document waits, then let through at rest, once."""
    from vitrine.operators import pipeline_status
    from vitrine.streaming.refresh import activate_checkpoint

    log = view(spark, folder, "stage_events")
    total = log.count()

    def gate(events: DataFrame) -> DataFrame:
        counts = pipeline_status.stage_counts(events)
        return pipeline_status.stability(pipeline_status.status_of(counts, events))

    _stored, marks = scratch_tables(spark)
    activate_checkpoint(marks, "first", 1000, total, gate(log.withColumn("stage", F.lit("pending"))))
    at_rest = gate(log.withColumn("stage", F.lit("indexed")))
    for watermark in (2000, 3000):
        activate_checkpoint(marks, "second", watermark, total, at_rest)
    return marks.read()
