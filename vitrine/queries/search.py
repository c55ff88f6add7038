"""Vector, fused and lexical search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.fixtures import table, view, with_views
from vitrine.functions import vectors as V
from vitrine.functions.text import normalize_query, tokens
from vitrine.operators import fusion, lexical
from vitrine.operators import vector_search as vs
from vitrine.operators.declared_schema import apply_schema, checked_filter
from vitrine.operators.embedding import embed_texts, hashed_tokens_encoder
from vitrine.operators.hashed_neighbours import hashed_neighbours, recall
from vitrine.operators.neighbours import all_neighbours
from vitrine.plans import search_job
from vitrine.queries.registry import query
from vitrine.session import settle


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "products")


def whole_number(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


# Distance of every request (r) and document (d), computed in doubles.
DIST = "round(list_cosine_distance(cast(r.vector as double[]), cast(d.vector as double[])),6)+0.0"


def ranked_pairs(where: str, requests: str = "products", k: int = 10) -> str:
    return f"""pairs as (select r.id as request_id, d.id, {DIST} as dist from {requests} r, products d where {where}),
    ranked as (select *, row_number() over (partition by request_id order by dist, id) as rank from pairs
               qualify rank<={k})"""


@query(
    "vector_top_k",
    covers="R1 P11",
    sql=with_views("products", extra=ranked_pairs("true")) + "select request_id, id, dist, rank from ranked",
)
def vector_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored vector as a query against the whole table."""
    docs = stored(spark, folder)
    requests = docs.select(F.col("id").alias("request_id"), "vector")
    return whole_number(vs.vector_top_k(docs, requests))


@query(
    "vector_top_k_filtered",
    covers="R1 P11 P12 K6",
    sql=with_views("products", extra=ranked_pairs(
        "d.category='cat'||((cast(substr(r.category,4) as int)+1)%10) and d.upserted_at>r.upserted_at-720000000 "
        "and d.upserted_at<=r.upserted_at+720000000 and d.category<>'cat7'"))
    + "select request_id, id, dist, rank from ranked",
)
def vector_top_k_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Each request wants the next category, near its own time; cat7 is shut for all."""
    docs = stored(spark, folder)
    shared = ["category", "NotEq", "cat7"]
    wanted = F.pmod(F.substring("category", 4, 9).cast("int") + 1, F.lit(10))
    requests = docs.select(
        F.col("id").alias("request_id"),
        "vector",
        F.concat(F.lit("cat"), wanted.cast("string")).alias("category"),
        (F.col("upserted_at") - 720000000).alias("lo"),
        (F.col("upserted_at") + 720000000).alias("hi"),
    )
    pool = checked_filter(docs.select("id", "category", "vector", "upserted_at"), shared)
    return whole_number(vs.vector_top_k(pool, requests))


@query(
    "vector_top_k_blocks",
    covers="R1",
    sql=with_views("products", extra=ranked_pairs("true", k=5)) + "select request_id, id, dist, rank from ranked",
)
def vector_top_k_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The shuffled form for request tables too large to broadcast."""
    docs = stored(spark, folder)
    requests = docs.select(F.col("id").alias("request_id"), "vector")
    found = vs.vector_top_k(
        docs, requests, 5, broadcast_limit=0, block_docs=256, block_requests=256
    )
    return whole_number(found)


@query(
    "vector_next_page",
    covers="R14",
    sql=with_views("products", extra=ranked_pairs("true", k=10))
    + """select request_id, id, dist, rank-5 as rank from ranked where rank>5""",
)
def vector_next_page(spark: SparkSession, folder: str) -> DataFrame:
    """Second page of five, found from the cursor of the first."""
    docs = stored(spark, folder)
    requests = docs.select(F.col("id").alias("request_id"), "vector")
    first = vs.vector_top_k(docs, requests, 5)
    following = requests.join(vs.next_cursor(first, 5), "request_id")
    return whole_number(vs.vector_top_k(docs, following, 5))


@query(
    "radius_count",
    covers="A9",
    sql=with_views("products", extra=f"""pairs as (select r.id as request_id, {DIST} as dist from products r, products d
        where d.category=r.category)""")
    + """select request_id, count(*) filter (dist<=0.75) as count, false as bounded, false as approximate,
    cast(0.75 as double) as max_distance from pairs group by request_id""",
)
def radius_count(spark: SparkSession, folder: str) -> DataFrame:
    docs = stored(spark, folder)
    requests = docs.select(F.col("id").alias("request_id"), "vector", "category")
    return vs.radius_count(docs, requests, 0.75)


@query(
    "search_with_count",
    covers="R1 A9",
    sql=with_views("products", extra=f"""pairs as (select r.id as request_id, d.id, {DIST} as dist from products r, products d),
    ranked as (select *, row_number() over (partition by request_id order by dist, id) as rank from pairs qualify rank<=3)""")
    + """select request_id, 0 as rank, cast(null as varchar) as id, cast(null as double) as dist,
      count(*) filter (dist<=0.75) as match_count from pairs group by request_id
    union all select request_id, rank, id, dist, null from ranked""",
)
def search_with_count(spark: SparkSession, folder: str) -> DataFrame:
    """Hits and radius count of every request from one scan."""
    docs = stored(spark, folder)
    requests = docs.select(F.col("id").alias("request_id"), "vector")
    return whole_number(vs.search_with_count(docs, requests, 3, 0.75))


@query(
    "nearest_to_id",
    covers="R2 J4 J8",
    sql=with_views("products", extra=ranked_pairs("r.id<>d.id and d.category=r.category"))
    + "select request_id, id, dist, rank from ranked",
)
def nearest_to_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = stored(spark, folder)
    seeds = docs.select(F.col("id").alias("request_id"), F.col("id").alias("seed_id"), "category")
    return whole_number(vs.nearest_to_id(docs, seeds))


@query(
    "seed_lookup",
    covers="J4",
    sql=with_views("products", "user_views", extra="seeds as (select distinct user_id as request_id, doc_id as seed_id from user_views union select user_id, 'X'||doc_id from user_views)")
    + """select request_id, seed_id, p.id is null as missing from seeds left join products p on p.id=seed_id""",
)
def seed_lookup(spark: SparkSession, folder: str) -> DataFrame:
    views = view(spark, folder, "user_views")
    known = views.select(F.col("user_id").alias("request_id"), F.col("doc_id").alias("seed_id"))
    unknown = known.withColumn("seed_id", F.concat(F.lit("X"), "seed_id"))
    seeds = known.unionAll(unknown).distinct()
    return vs.resolve_seeds(stored(spark, folder), seeds).select("request_id", "seed_id", "missing")


FUSION = f"""
seen as (select user_id as request_id, doc_id as seed_id, min(event_id) as pos from user_views group by all),
cut as (select *, row_number() over (partition by request_id order by pos, seed_id)-1 as leg from seen qualify leg<16),
legs as (select * from cut where request_id in (select request_id from cut group by request_id having count(*)>=2)),
distinct_seeds as (select distinct id, vector from products where id in (select seed_id from legs)),
pairs as (select r.id as seed_id, d.id, {DIST} as dist from distinct_seeds r, products d where r.id<>d.id),
hits as (select *, row_number() over (partition by seed_id order by dist, id)-1 as place from pairs qualify place<8),
fused as (select request_id, id, round(sum(1.0/(61+place)),12) as score, min((leg, place)) as met
          from legs join hits using (seed_id)
          where not exists (select 1 from legs o where o.request_id=legs.request_id and o.seed_id=hits.id)
          group by request_id, id)
"""


@query(
    "rank_fusion",
    covers="R3 J8",
    sql=with_views("products", "user_views", extra=FUSION)
    + """select request_id, id, round(score,9) as score, row_number() over (partition by request_id order by score desc, met) as rank
    from fused qualify rank<=8""",
)
def rank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's first sixteen distinct views, fused."""
    seeds = view(spark, folder, "user_views").select(
        F.col("user_id").alias("request_id"),
        F.col("event_id").alias("pos"),
        F.col("doc_id").alias("seed_id"),
    )
    fused = fusion.multi_seed(stored(spark, folder), seeds)
    return fused.select(
        "request_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank")
    )


@query(
    "all_neighbours_exact",
    covers="R4 R2",
    sql=with_views("products", extra=ranked_pairs("r.id<>d.id")) + "select request_id, id, dist, rank from ranked",
)
def all_neighbours_exact(spark: SparkSession, folder: str) -> DataFrame:
    return whole_number(all_neighbours(stored(spark, folder)))


@query("all_neighbours_probed", covers="R4")
def all_neighbours_probed(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate form: own cell and the two nearest others."""
    return whole_number(all_neighbours(stored(spark, folder), probes=3))


@query(
    "neighbours_hashed_recall",
    covers="R4",
    sql=with_views("products", extra=ranked_pairs("r.id<>d.id"))
    + "select count(*) as neighbours, true as reached, cast(0 as bigint) as too_near from ranked",
)
def neighbours_hashed_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The hashed search of every item held against the exact one.

    ``reached``: at least nine tenths of the exact neighbours are found;
    ``too_near``: hits closer than the exact hit of their rank, which cannot be.
    """
    docs = stored(spark, folder)
    exact, found = settle(all_neighbours(docs)), settle(hashed_neighbours(docs))
    ranked = exact.select("request_id", "rank", F.col("dist").alias("nearest"))
    impossible = found.join(ranked, ["request_id", "rank"], "left").agg(
        F.count_if(F.col("nearest").isNull() | (F.col("dist") < F.col("nearest") - 2e-6)).alias("too_near")
    )
    return recall(exact, found).crossJoin(impossible).select(
        "neighbours", (F.col("recall") >= 0.9).alias("reached"), "too_near"
    )


@query(
    "featured_blend",
    covers="R9",
    sql=with_views("products", extra=f"""seeds as (select * from (select id, vector, row_number() over (partition by category order by upserted_at desc) as n,
        category from products) where n=1),
    pairs as (select r.category as query_pos, d.id, {DIST} as dist from seeds r, products d),
    ranked as (select query_pos, id, row_number() over (partition by query_pos order by dist, id) as rank from pairs qualify rank<=6),
    firsts as (select id, min((query_pos, rank)) as met from ranked group by id)""")
    + """select met[1] as query_pos, met[2] as rank, id from firsts order by met, id limit 12""",
)
def featured_blend(spark: SparkSession, folder: str) -> DataFrame:
    """The newest item of each category stands for a front-page query."""
    docs = stored(spark, folder)
    newest = docs.groupBy("category").agg(F.max_by("vector", "upserted_at").alias("vector"))
    requests = newest.select(F.col("category").alias("request_id"), "vector")
    hits = vs.vector_top_k(docs, requests, 6).withColumnRenamed("request_id", "query_pos")
    return whole_number(fusion.featured(hits))


@query(
    "featured_fallback",
    covers="R9 P10",
    sql=with_views("products")
    + "select id, cast(avg_rating_txt as double) as rating from products order by rating desc, id limit 12",
)
def featured_fallback(spark: SparkSession, folder: str) -> DataFrame:
    from vitrine.operators.products import cards

    return fusion.featured_fallback(cards(stored(spark, folder))).select(
        F.col("asin").alias("id"), "rating"
    )


@query(
    "unit_vectors",
    covers="U3",
    sql="""select vec_id, round(sqrt(list_sum([x*x for x in scaled])),6) as norm, round(scaled[1],6) as first,
    round(list_cosine_distance(scaled, back),6)+0.0 as to_reverse from (
      select vec_id, [cast(x as double)*(vec_id+1) for x in embedding] as v,
             [x/sqrt(list_sum([y*y for y in v])) for x in v] as scaled, list_reverse(v) as back from embeddings)""",
)
def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1)).alias("v"),
    )
    scaled = rows.withColumn("scaled", V.l2_normalize(F.col("v")))
    return scaled.select(
        "vec_id",
        F.round(V.l2_norm(F.col("scaled")), 6).alias("norm"),
        F.round(F.get("scaled", F.lit(0)), 6).alias("first"),
        (V.rounded(V.cosine_distance(F.col("scaled"), F.reverse("v"))) + 0.0).alias("to_reverse"),
    )


# --- Text ---


@query(
    "search_refusals",
    covers="J5",
    sql=with_views("checkpoints", "user_views")
    + """, asked as (select event_id as request_id, case when event_id%2=0 then label else 'no-'||label end as label
      from user_views v join (select *, row_number() over (order by label)-1 as n, count(*) over () as c from checkpoints) m
      on v.user_id%c=n)
    select request_id, 'unknown catalog checkpoint: '||label as error from asked where label not in (select label from checkpoints)""",
)
def search_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """A request per view, every other one with a label that no checkpoint has."""
    from vitrine.operators.ordinals import with_ordinals

    marks = view(spark, folder, "checkpoints")
    count = marks.count()
    named = with_ordinals(marks.select("label"), ["label"], "n")
    views = view(spark, folder, "user_views").withColumn("n", F.col("user_id") % count)
    label = F.when(F.col("event_id") % 2 == 0, F.col("label")).otherwise(F.concat(F.lit("no-"), "label"))
    asked = views.join(named, "n").select(F.col("event_id").alias("request_id"), label.alias("label"))
    return search_job.refused_requests(asked, marks, lookup=None)


@query(
    "hit_attributes",
    covers="P9",
    sql=with_views("products", "user_views")
    + "select distinct user_id as request_id, p.id, p.title, p.category from user_views v join products p on p.id=v.doc_id",
)
def hit_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Viewed products as hits with two of their attributes; unknown names are passed over."""
    hits = view(spark, folder, "user_views").select(
        F.col("user_id").alias("request_id"), F.col("doc_id").alias("id")
    ).distinct()
    found = search_job.with_attributes(hits, stored(spark, folder), ["title", "id", "category", "unheard_of"])
    return found.select("request_id", "id", "title", "category")


@query("text_search", covers="U2 R1 P9 P10")
def text_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct logged query, encoded, against the encoded product texts."""
    encoder = hashed_tokens_encoder()
    docs = embed_texts(stored(spark, folder).drop("vector"), encoder, "description")
    logged = view(spark, folder, "search_history").select(
        normalize_query(F.col("raw_query")).alias("query")
    )
    requests = logged.filter(F.col("query").isNotNull()).distinct().withColumn(
        "request_id", F.col("query")
    )
    hits = search_job.search(docs, requests, encoder)
    return search_job.with_cards(hits, docs).select(
        "request_id", "rank", "id", "dist", "title", "category"
    )


@query(
    "document_vectors",
    covers="U2",
    sql=r"""select doc_id, 64 as dims, case when regexp_matches(text,'[\p{L}\p{N}_]') then cast(1 as double) else 0 end as norm
    from documents""",
)
def document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts through the text encoder."""
    docs = embed_texts(table(spark, folder, "documents"), hashed_tokens_encoder())
    return docs.select(
        "doc_id", F.size("vector").alias("dims"), F.round(V.l2_norm(F.col("vector")), 4).alias("norm")
    )


@query(
    "text_tokens",
    covers="P16",
    sql="""select doc_id, len(t) as n, coalesce(t[1],'') as first, coalesce(t[len(t)],'') as last from (
    select doc_id, [x for x in string_split_regex(lower(text),'[^a-z0-9]+') if length(x)>1] as t from documents)""",
)
def text_tokens(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return found.select(
        "doc_id",
        F.size("t").cast("long").alias("n"),
        F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"),
        F.coalesce(F.try_element_at("t", F.lit(-1)), F.lit("")).alias("last"),
    )


QUERY_TOKENS = r"""
asked as (select distinct trim(regexp_replace(lower(raw_query),'\s+',' ','g')) as query from search_history),
words as (select query, unnest([x for x in string_split_regex(lower(query),'[^a-z0-9]+') if length(x)>1]) as w from asked)
"""


def asked(spark: SparkSession, folder: str) -> DataFrame:
    logged = view(spark, folder, "search_history").select(
        normalize_query(F.col("raw_query")).alias("query")
    )
    return logged.filter(F.col("query").isNotNull()).distinct().withColumn("request_id", F.col("query"))


def lexical_sql(pool: str, k: int) -> str:
    return f"""
scored as (select query, id, sum(4*(contains(lower(title),w))::int + 3*(lower(category)=w)::int
             + (contains(lower(title||' '||description||' '||category),w))::int) + any_value(pop) as score
           from words, (select *, 0.4*log10(rating_count+1)+0.5*(rating-4) as pop from {pool}) p group by query, id)
select query as request_id, id, score, row_number() over (partition by query order by score desc, id) as rank
from (select query, id, round(score,6) as score from scored) where score>0 qualify rank<={k}"""


@query(
    "lexical_products",
    covers="R5",
    sql=with_views("products", "search_history", extra=f"""{QUERY_TOKENS},
    pool as (select id, title, description, category, cast(avg_rating_txt as double) as rating,
             cast(rating_cnt_txt as double) as rating_count from products),""" + lexical_sql("pool", 24)[1:]),
)
def lexical_products(spark: SparkSession, folder: str) -> DataFrame:
    pool = stored(spark, folder).select(
        "id",
        "title",
        "description",
        "category",
        F.col("avg_rating_txt").cast("double").alias("rating"),
        F.col("rating_cnt_txt").cast("double").alias("rating_count"),
    )
    return whole_number(lexical.lexical_top_k(pool, asked(spark, folder)))


DOCUMENT_POOL = """
pool as (select cast(doc_id as varchar) as id, source as title, text as description, lang as category,
         cast(doc_id%5 as double) as rating, cast(n_chars as double) as rating_count from documents),
"""


@query(
    "lexical_documents",
    covers="R5",
    sql="with words as (select source||' '||lang as query, unnest([x for x in string_split_regex(lower(source||' '||lang||' '||role),'[^a-z0-9]+') if length(x)>1]) as w"
    " from (select distinct source, lang from documents), (select distinct role from conversations where role='user')),"
    + DOCUMENT_POOL
    + lexical_sql("pool", 24)[1:],
)
def lexical_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole document texts ranked for a query per source and language."""
    docs = table(spark, folder, "documents")
    pool = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("title"),
        F.col("text").alias("description"),
        F.col("lang").alias("category"),
        (F.col("doc_id") % 5).cast("double").alias("rating"),
        F.col("n_chars").cast("double").alias("rating_count"),
    )
    requests = docs.select("source", "lang").distinct().select(
        F.concat_ws(" ", "source", "lang").alias("request_id"),
        F.concat_ws(" ", "source", "lang", F.lit("user")).alias("query"),
    )
    return whole_number(lexical.lexical_top_k(pool, requests))


@query(
    "popular_products",
    covers="R6",
    sql=with_views("products")
    + "select id, cast(rating_cnt_txt as bigint) as rating_count from products order by rating_count desc, id limit 24",
)
def popular_products(spark: SparkSession, folder: str) -> DataFrame:
    pool = stored(spark, folder).select("id", F.col("rating_cnt_txt").cast("long").alias("rating_count"))
    return lexical.popular(pool)


@query(
    "similar_items",
    covers="R7",
    sql=with_views("products", extra="""
    seeds as (select id, category, price, [x for x in string_split_regex(lower(title),'[^a-z0-9]+') if length(x)>1] as t from products),
    scored as (select s.id as request_id, d.id, round(5*(s.category=d.category)::int
        + list_sum([contains(lower(d.title||' '||d.description), x)::int for x in s.t])
        + 1.5*coalesce(least(d.price,s.price)/greatest(d.price,s.price),0),6) as score
        from seeds s, products d where s.id<>d.id)""")
    + """select request_id, id, score, row_number() over (partition by request_id order by score desc, id) as rank
    from scored qualify rank<=6""",
)
def similar_items(spark: SparkSession, folder: str) -> DataFrame:
    docs = stored(spark, folder).drop("vector")
    seeds = docs.select(F.col("id").alias("request_id"), F.col("id").alias("seed_id"))
    return whole_number(lexical.similar_items(docs, seeds))


@query(
    "declared_table",
    covers="K6 P9",
    sql=with_views("products")
    + "select id, category, title from products where category='cat3' and upserted_at>1704067200000 and id<>'V3'",
)
def declared_table(spark: SparkSession, folder: str) -> DataFrame:
    """Typed by the declared schema and filtered through a checked tree."""
    typed = apply_schema(stored(spark, folder).drop("vector"))
    tree = [["category", "Eq", "cat3"], ["upserted_at", "Gt", 1704067200000], ["id", "NotEq", "V3"]]
    return checked_filter(typed, tree).select("id", "category", "title")
