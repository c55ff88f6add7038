"""Pipeline status, blob and backfill queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.fixtures import table, view, with_views
from vitrine.operators import blobs, pipeline_status
from vitrine.plans.backfill_job import backfill
from vitrine.queries.registry import query
from vitrine.session import ensure_checkpoint_dir


def stage_log(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "stage_events")


def pipelines(spark: SparkSession, folder: str) -> DataFrame:
    """Pipelines in the log, and one per pipeline that does not exist."""
    known = stage_log(spark, folder).select("pipeline_id")
    return known.unionAll(known.select(F.concat(F.lit("no-"), "pipeline_id"))).distinct()


LAST = """
last as (select pipeline_id, doc_id, arg_max(stage,(ts_ms,event_id)) as stage, max(ts_ms) as ts_ms from stage_events group by all),
counts as (select pipeline_id, stage, count(*) as doc_count from last group by all),
wanted as (select distinct pipeline_id from stage_events union select distinct 'no-'||pipeline_id from stage_events),
status as (select pipeline_id, cast(coalesce(sum(doc_count) filter (stage='pending'),0) as bigint) as pending_count,
    cast(coalesce(sum(doc_count) filter (stage not in ('pending','indexed','completed','complete','failed')),0) as bigint) as processing_count,
    cast(coalesce(sum(doc_count) filter (stage='failed'),0) as bigint) as failed_count,
    cast(coalesce(sum(doc_count) filter (stage='indexed'),0) as bigint) as indexed_count
    from wanted left join counts using (pipeline_id) group by pipeline_id)
"""


@query(
    "latest_stages",
    covers="A7",
    sql=with_views("stage_events", extra=LAST) + "select pipeline_id, doc_id, stage, ts_ms from last",
)
def latest_stages(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline_status.latest_stages(stage_log(spark, folder)).drop("event_id")


@query(
    "stage_counts",
    covers="A7",
    sql=with_views("stage_events", extra=LAST) + "select * from counts",
)
def stage_counts(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline_status.stage_counts(stage_log(spark, folder))


@query(
    "stability_gate",
    covers="A8 A7",
    sql=with_views("stage_events", extra=LAST)
    + "select *, pending_count=0 and processing_count<=1 as stable from status",
)
def stability_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Failures allowed, one document may be in flight."""
    counts = pipeline_status.stage_counts(stage_log(spark, folder))
    status = pipeline_status.status_of(counts, pipelines(spark, folder))
    return pipeline_status.stability(status, allowed_processing=1, allow_failed=True)


@query(
    "stability_allowances",
    covers="A8",
    sql=with_views("stage_events", extra=LAST)
    + """select *, pending_count=0 and failed_count=0 and
      processing_count<=case when pipeline_id like 'no-%' then 0 else 1 end as stable from status""",
)
def stability_allowances(spark: SparkSession, folder: str) -> DataFrame:
    """One document may be in flight in the pipelines of the log, none elsewhere."""
    log = stage_log(spark, folder)
    status = pipeline_status.status_of(pipeline_status.stage_counts(log), pipelines(spark, folder))
    return pipeline_status.stability(status, F.when(F.col("pipeline_id").startswith("no-"), 0).otherwise(1))


@query(
    "stated_status",
    covers="A7 A8",
    sql=with_views("stage_events", extra="""per_doc as (select doc_id, count(*) filter (stage='pending') as p, count(*) filter (stage='failed') as f,
      count(*) filter (stage='indexed') as i, count(*) filter (stage not in ('pending','indexed','completed','complete','failed')) as r
      from stage_events group by all)""")
    + """select doc_id as pipeline_id, cast(p+1 as bigint) as pending_count, cast(r as bigint) as processing_count,
      cast(0 as bigint) as failed_count, cast(i as bigint) as indexed_count from per_doc""",
)
def stated_status(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's stage counts as a status that states other waiting and failed counts."""
    per_doc = stage_log(spark, folder).groupBy("doc_id", "stage").agg(F.count("*").alias("n"))
    statuses = per_doc.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("stage", "n"))).alias("stages"),
        (F.coalesce(F.sum(F.when(F.col("stage") == "pending", F.col("n"))), F.lit(0)) + 1).alias("pending_count"),
        F.lit(0).alias("failed_count"),
        F.lit("unknown").alias("processing_count"),
    )
    text = F.to_json(F.struct("stages", "pending_count", "failed_count", "processing_count"))
    return pipeline_status.status_from_json(statuses.select(F.col("doc_id").alias("pipeline_id"), text.alias("status")))


@query(
    "stability_blockers",
    covers="A8",
    sql=with_views("stage_events", extra=LAST)
    + """select pipeline_id, pending_count, processing_count, failed_count from status
    where not (pending_count=0 and processing_count=0 and failed_count=0)""",
)
def stability_blockers(spark: SparkSession, folder: str) -> DataFrame:
    counts = pipeline_status.stage_counts(stage_log(spark, folder))
    gate = pipeline_status.stability(pipeline_status.status_of(counts, pipelines(spark, folder)))
    return pipeline_status.blockers(gate).select(
        "pipeline_id", "pending_count", "processing_count", "failed_count"
    )


@query(
    "status_encodings",
    covers="A7",
    sql=with_views("stage_events", extra="""per_doc as (select doc_id, stage, count(*) as n from stage_events group by all),
    docs as (select distinct doc_id from per_doc)""")
    + """select doc_id as pipeline_id, stage, n as doc_count from per_doc
    union all select doc_id||'-list', stage, n from per_doc
    union all select doc_id||'-flat', stage, n from per_doc""",
)
def status_encodings(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's stage counts written in the three encodings and read back."""
    per_doc = stage_log(spark, folder).groupBy("doc_id", "stage").agg(F.count(F.lit(1)).alias("n"))
    grouped = per_doc.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("stage", "n"))).alias("m"),
        F.collect_list(F.struct("stage", F.col("n").alias("count"))).alias("l"),
    )
    as_object = grouped.select("doc_id", F.to_json(F.struct(F.col("m").alias("counts"), F.lit("x").alias("id"))).alias("status"))
    as_list = grouped.select(
        F.concat("doc_id", F.lit("-list")), F.to_json(F.struct(F.lit(7).alias("stages"), F.col("l").alias("stage_counts")))
    )
    as_flat = grouped.select(
        F.concat("doc_id", F.lit("-flat")), F.to_json("m")
    )
    statuses = as_object.unionAll(as_list).unionAll(as_flat).withColumnRenamed("doc_id", "pipeline_id")
    return pipeline_status.counts_from_status(statuses)


@query(
    "index_throughput",
    covers="A13",
    sql=with_views("stage_events")
    + """select pipeline_id, (ts_ms//3600000+1)*3600000 as window_end_ms, count(*) filter (stage='indexed') as indexed,
    count(*) filter (stage='indexed')/60.0 as per_minute from stage_events group by all""",
)
def index_throughput(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline_status.index_throughput(stage_log(spark, folder), 60)


# --- Blobs ---

MANGLED = """
refs as (select id, image_url, case category when 'cat1' then replace(image_blob,'blob://','blob:/') when 'cat2' then image_blob||'0'
    when 'cat3' then '  '||upper(substr(image_blob,17))||' ' when 'cat4' then '  '||image_blob||'  '
    when 'cat5' then 'blob://products/'||upper(substr(image_blob,17)) else image_blob end as image_blob from products),
checked as (select *, case when trim(coalesce(image_blob,''))='' then 'none'
    when regexp_full_match(trim(image_blob),'blob://[^/]+/[0-9a-fA-F]{64}') then 'ok' else 'invalid' end as status,
    lower(substr(trim(image_blob),17)) as digest from refs)
"""


def mangled(spark: SparkSession, folder: str) -> DataFrame:
    """Products whose references are damaged differently in some categories."""
    ref, category = F.col("image_blob"), F.col("category")
    digest = F.upper(F.substring(ref, 17, 64))
    damaged = (
        F.when(category == "cat1", F.replace(ref, F.lit("blob://"), F.lit("blob:/")))
        .when(category == "cat2", F.concat(ref, F.lit("0")))
        .when(category == "cat3", F.concat(F.lit("  "), digest, F.lit(" ")))
        .when(category == "cat4", F.concat(F.lit("  "), ref, F.lit("  ")))
        .when(category == "cat5", F.concat(F.lit("blob://products/"), digest))
        .otherwise(ref)
    )
    return view(spark, folder, "products").select("id", "image_url", damaged.alias("image_blob"))


def stored_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Stored blobs: one per image url that was clicked, sized by price."""
    clicked = view(spark, folder, "clickstream").select(F.col("doc_id").alias("id")).distinct()
    docs = view(spark, folder, "products").filter(F.col("image_url").isNotNull())
    return docs.join(clicked, "id", "left_semi").select(
        F.sha2("image_url", 256).alias("sha"), F.col("price").cast("long").alias("size")
    )


STORED = """
blobs as (select sha256(image_url) as sha, cast(trunc(price) as bigint) as size from products
    where image_url is not null and id in (select doc_id from clickstream))
"""


@query(
    "blob_ref_status",
    covers="P18",
    sql=with_views("products", extra=MANGLED)
    + "select id, status, case when status='ok' then digest end as sha from checked",
)
def blob_ref_status(spark: SparkSession, folder: str) -> DataFrame:
    return blobs.referenced(mangled(spark, folder))


@query(
    "blob_audit",
    covers="J7 P18",
    sql=with_views("products", "clickstream", extra=f"{MANGLED}, {STORED}")
    + """select count(*) as documents_scanned, count(*) filter (status<>'none') as refs_seen, count(*) filter (status='invalid') as invalid_refs,
    (select count(*) from blobs where sha in (select digest from checked where status='ok')) as objects,
    count(*) filter (status='ok' and digest not in (select sha from blobs)) as missing,
    (select cast(coalesce(sum(size),0) as bigint) from blobs where sha in (select digest from checked where status='ok')) as bytes
    from checked""",
)
def blob_audit(spark: SparkSession, folder: str) -> DataFrame:
    return blobs.reference_audit(mangled(spark, folder), stored_blobs(spark, folder))


@query(
    "blob_budget",
    covers="R18",
    sql=with_views("products", "clickstream", extra=f"""{STORED},
    firsts as (select substr(image_blob,17) as sha, min(id) as id from products where image_blob is not null group by 1),
    totals as (select id, sha, size, sum(size) over (order by id, sha) as running from firsts join blobs using (sha)),
    budget as (select cast(sum(size)//2 as bigint) as b from totals)""")
    + """select id, sha, size, cast(running as bigint) as running_total, running<=b as chosen from totals, budget""",
)
def blob_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Half of all referenced bytes fit."""
    docs = view(spark, folder, "products")
    held = stored_blobs(spark, folder)
    refs = blobs.referenced(docs).select("sha").distinct()
    total = held.join(refs, "sha").agg(F.sum("size")).first()[0]
    return blobs.budget_prefix(docs, held, (total or 0) // 2)


@query(
    "blob_budget_summary",
    covers="R18",
    sql=with_views("products", "clickstream", extra=f"""{STORED},
    firsts as (select substr(image_blob,17) as sha, min(id) as id from products where image_blob is not null group by 1),
    totals as (select id, sha, size, sum(size) over (order by id, sha) as running from firsts join blobs using (sha))""")
    + """select count(*) filter (running<=9000) as objects, cast(coalesce(sum(size) filter (running<=9000),0) as bigint) as bytes,
    coalesce(bool_or(running>9000),false) as budget_exhausted from totals""",
)
def blob_budget_summary(spark: SparkSession, folder: str) -> DataFrame:
    docs = view(spark, folder, "products")
    return blobs.budget_summary(blobs.budget_prefix(docs, stored_blobs(spark, folder), 9000))


STATES = """
states as (select id, image_url, case when trim(coalesce(image_blob,'')) like 'blob://%' then 'already'
    when coalesce(image_url,'')<>'' then 'candidate' else 'missing_url' end as state from products)
"""


@query(
    "backfill_candidates",
    covers="J9",
    sql=with_views("products", extra=STATES) + "select id, image_url, state from states",
)
def backfill_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return blobs.backfill_states(view(spark, folder, "products"))


@query(
    "backfill_dry_run",
    covers="J9 A11 J2",
    sql=with_views("products", "clickstream", extra=f"""{STATES},
    wanted as (select distinct doc_id as id from clickstream union select distinct trace_id from clickstream),
    seen as (select w.id, coalesce(state,'absent') as state from wanted w left join states s on s.id=w.id)""")
    + """select count(*) as inspected, count(*) filter (state<>'absent') as fetched, count(*) filter (state='already') as already_backfilled,
    count(*) filter (state in ('missing_url','absent')) as missing_image_url, count(*) filter (state='candidate') as attempted,
    cast(0 as bigint) as patched, cast(0 as bigint) as failed, cast(0 as bigint) as bytes_stored from seen""",
)
def backfill_dry_run(spark: SparkSession, folder: str) -> DataFrame:
    clicked = view(spark, folder, "clickstream")
    ids = clicked.select(F.col("doc_id").alias("id")).unionAll(clicked.select("trace_id"))
    return backfill(view(spark, folder, "products"), "products", ids=ids)[1]


def new_blob_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/blobs-{uuid.uuid4()}"


def stand_in_image(url: str) -> bytes:
    """Bytes of an image; items whose number ends in 7 cannot be fetched."""
    if url.endswith("7.jpg"):
        raise OSError("not reachable")
    return url.encode()


@query(
    "backfill_applied",
    covers="J9 K5 K2 S9 A11",
    sql=with_views("products", extra=STATES)
    + """select id, case when state='candidate' and image_url not like '%7.jpg' then 'blob://products/'||sha256(image_url)
    else image_blob end as image_blob from products join states using (id, image_url)
    union all select id, image_blob from products where image_url is null""",
)
def backfill_applied(spark: SparkSession, folder: str) -> DataFrame:
    docs = view(spark, folder, "products")
    return backfill(docs, "products", stand_in_image, blob_folder=new_blob_folder(spark))[0].select("id", "image_blob")


@query(
    "backfill_read_back",
    covers="K5 J9 J7",
    sql=with_views("products", extra=STATES)
    + """select id, sha256(image_url) as sha, cast(length(image_url) as bigint) as size, true as intact
    from products join states using (id, image_url) where state='candidate' and image_url not like '%7.jpg'""",
)
def backfill_read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes written by a backfill, read through the references it patched in."""
    docs = view(spark, folder, "products")
    kept = new_blob_folder(spark)
    filled = backfill(docs, "products", stand_in_image, blob_folder=kept)[0]
    fresh = filled.join(docs.filter("image_blob is not null").select("id"), "id", "left_anti")
    refs = blobs.referenced(fresh).filter("sha is not null").select("id", "sha")
    held = blobs.stored_blobs(spark, kept)
    return refs.join(held, "sha", "left").select(
        "id", "sha", "size", (F.sha2("content", 256) == F.col("sha")).alias("intact")
    )


@query(
    "backfill_statistics",
    covers="A11 S9",
    sql=with_views("products", extra=f"""{STATES},
    tried as (select image_url, image_url not like '%7.jpg' as good from states where state='candidate')""")
    + """select count(*) as inspected, count(*) as fetched, count(*) filter (state='already') as already_backfilled,
    count(*) filter (state='missing_url') as missing_image_url, count(*) filter (state='candidate') as attempted,
    (select count(*) from tried where good) as patched, (select count(*) from tried where not good) as failed,
    (select cast(sum(length(image_url)) as bigint) from tried where good) as bytes_stored from states""",
)
def backfill_statistics(spark: SparkSession, folder: str) -> DataFrame:
    docs = view(spark, folder, "products")
    return backfill(docs, "products", stand_in_image, blob_folder=new_blob_folder(spark))[1]


@query(
    "distinct_blobs",
    covers="K5",
    sql="""select sha256(text) as sha, min(cast(doc_id as varchar)) as id, 'blob://documents/'||sha256(text) as ref,
    cast(octet_length(encode(any_value(text))) as bigint) as size from documents group by text""",
)
def distinct_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Document texts as contents; equal ones are stored once."""
    contents = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.encode("text", "UTF-8").alias("content")
    )
    stored = blobs.distinct_blobs(blobs.addressed(contents, "documents"))
    return stored.select("sha", "id", "ref", "size")


@query(
    "undiscovered_rows",
    covers="U5",
    sql=with_views("products") + "select id, title from products where image_blob is null",
)
def undiscovered_rows(spark: SparkSession, folder: str) -> DataFrame:
    from vitrine.operators.embedding import undiscovered

    return undiscovered(view(spark, folder, "products"), "image_blob").select("id", "title")
