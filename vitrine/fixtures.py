"""Catalog-shaped views derived from the test tables.

Each view exists twice: as Spark SQL for the jobs and as DuckDB SQL for the
checks. ``view`` builds a DataFrame, ``with_views`` the WITH clause of a check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# First upsert time of the derived products and the step between products.
BASE_MS = 1704067200000
STEP_MS = 3600000
DROP_ROWS = 60

PRODUCTS = """
select 'V'||cast(vec_id as {text}) as id, p_name as title, 'cat'||cast(label as {text}) as category,
       p_brand||' '||p_type||' '||p_name as description,
       case when vec_id%11=0 then null else 'http://img/'||cast(vec_id as {text})||'.jpg' end as image_url,
       case when vec_id%11<>0 and vec_id%3=0
            then 'blob://products/'||{sha}('http://img/'||cast(vec_id as {text})||'.jpg'{sha_bits}) end as image_blob,
       cast(3+vec_id%2 as {text})||'.'||cast(vec_id%10 as {text}) as avg_rating_txt,
       cast(vec_id*37%1000 as {text}) as rating_cnt_txt,
       p_retailprice as price, embedding as vector,
       1704067200000+vec_id*3600000 as upserted_at
from {embeddings} left join {part} on p_partkey = vec_id % (select count(*) from {part})
"""

# One drop per full run of sixty products, as the upsert times fall.
CHECKPOINTS = """
select 'catalog-'||{day_of_max} as label, max(upserted_at) as watermark_ms, count(*) as row_count
from {products} group by {drop_number}
"""

SEARCH_HISTORY = """
select event_id, 'u'||cast(user_id as {text})||'-'||{day} as trace_id, user_id,
       case when event_id%3=0 then '  '||upper(p_name)||' '
            when event_id%3=1 then replace(p_name,' ','   ') else p_name end as raw_query,
       {result_ids} as top_result_ids,
       {millis} as timestamp_ms,
       case when event_id%5=0 then 'page:next' else 'page:first' end as page_tag
from (select *, cast({k} as bigint) as k from {events} where event_type='view') e join {part} on p_partkey=k
"""

CLICKSTREAM = """
select event_id, 'u'||cast(user_id as {text})||'-'||{day} as trace_id,
       'V'||cast(cast({k} as bigint) as {text}) as doc_id, {millis} as timestamp_ms
from {events} where event_type='click'
"""

STAGE_EVENTS = """
select event_id, 'D'||cast(user_id as {text}) as doc_id,
       case when user_id%2=0 then 'extraction' else 'products' end as pipeline_id,
       case event_type when 'signup' then 'pending' when 'view' then 'embedding'
            when 'error' then 'failed' else 'indexed' end as stage, {millis} as ts_ms
from {events}
"""

USER_VIEWS = """
select event_id, user_id, 'V'||cast(cast({k} as bigint) as {text}) as doc_id, {millis} as ts_ms
from {events} where event_type in ('view','click')
"""

RAW_CATALOG = """
select p_partkey as row_no, p_type as category,
       case when p_partkey%13=0 then '' else 'B'||cast(p_partkey as {text}) end as parent_asin,
       case when p_partkey%26=0 then null else 'A'||cast(p_partkey as {text}) end as asin,
       ' '||p_name||' ' as title,
       case when p_partkey%4=0 then {no_text} else {brand_list} end as description,
       {features} as features,
       case when p_partkey%5=0 then 'None' when p_partkey%7=0 then ''
            else '$1,'||cast(100+p_size as {text})||'.50' end as price,
       cast(p_partkey%5 as {text})||'.5' as average_rating,
       '1,'||cast(100+p_size as {text}) as rating_number,
       case when p_partkey%9=0 then null else 'http://img/p'||cast(p_partkey as {text})||'.jpg' end as hi_res,
       case when p_partkey%18=0 then null else 'http://img/l'||cast(p_partkey as {text})||'.jpg' end as large
from {part}
"""

VIEWS = {
    "products": PRODUCTS,
    "checkpoints": CHECKPOINTS,
    "search_history": SEARCH_HISTORY,
    "clickstream": CLICKSTREAM,
    "stage_events": STAGE_EVENTS,
    "user_views": USER_VIEWS,
    "raw_catalog": RAW_CATALOG,
}

DRIVER_TABLES = (
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
)

SPARK_WORDS = {
    "text": "string",
    "sha": "sha2",
    "sha_bits": ",256",
    "day": "date_format(ts,'yyyyMMdd')",
    "millis": "unix_micros(cast(ts as timestamp)) div 1000",
    "k": "get_json_object(props,'$.k')",
    "result_ids": "transform(sequence(0,9), i -> 'V'||cast((k*7+i*3)%100 as string))",
    "no_text": "cast(array() as array<string>)",
    "brand_list": "array(p_brand,' ',p_type,'x','y')",
    "features": "array('f'||cast(p_size as string))",
    "day_of_max": "date_format(timestamp_millis(max(upserted_at)),'yyyy-MM-dd')",
    "drop_number": "(upserted_at - 1704067200000) div 216000000",
}

DUCKDB_WORDS = {
    "text": "varchar",
    "sha": "sha256",
    "sha_bits": "",
    "day": "strftime(ts,'%Y%m%d')",
    "millis": "epoch_us(ts)//1000",
    "k": "json_extract_string(props,'$.k')",
    "result_ids": "['V'||cast((k*7+i*3)%100 as varchar) for i in range(10)]",
    "no_text": "cast([] as varchar[])",
    "brand_list": "[p_brand,' ',p_type,'x','y']",
    "features": "['f'||cast(p_size as varchar)]",
    "day_of_max": "strftime(make_timestamp(max(upserted_at)*1000),'%Y-%m-%d')",
    "drop_number": "(upserted_at - 1704067200000)//216000000",
}


# Schemas seen so far, so that a table read again needs no job to infer it.
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One derived view over the tables in ``folder``."""
    text = VIEWS[name]
    inputs = {t: table(spark, folder, t) for t in DRIVER_TABLES if "{" + t + "}" in text}
    if "{products}" in text:
        inputs["products"] = view(spark, folder, "products")
    return spark.sql(text.format(**SPARK_WORDS, **{t: "{" + t + "}" for t in inputs}), **inputs)


def duckdb_view(name: str) -> str:
    names = {t: t for t in (*DRIVER_TABLES, *VIEWS)}
    return VIEWS[name].format(**DUCKDB_WORDS, **names).strip()


def with_views(*names: str, extra: str = "") -> str:
    """WITH clause defining the named views (and further parts after them)."""
    wanted = list(names)
    if "checkpoints" in wanted and "products" not in wanted:
        wanted.insert(0, "products")
    wanted.sort(key=list(VIEWS).index)
    parts = [f"{n} as ({duckdb_view(n)})" for n in wanted]
    return "with " + ",\n".join(parts) + (",\n" + extra if extra else "") + "\n"
