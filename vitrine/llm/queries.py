"""The registered queries of this package, with DuckDB checks where SQL can state them.

Each query gets its rows through its operator and derives the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.archives import read_packages, resolved, write_packages
from vitrine.llm.byteconv import languages
from vitrine.llm.cube import mix, word_count
from vitrine.llm.divergence import divergence
from vitrine.llm.filter_audit import audit
from vitrine.llm.frames import table
from vitrine.llm.fuzzy_lines import dedupe_lines
from vitrine.llm.golay import near_duplicates
from vitrine.llm.lm_scoring import language_scores
from vitrine.llm.packing import pack, pieces
from vitrine.llm.personal import KINDS, count_of, personal_spans, written
from vitrine.llm.quality import line_quality
from vitrine.llm.repeats import repeat_digests
from vitrine.llm.winnowing import contamination
from vitrine.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_recurrent_scoring(spark: SparkSession, folder: str) -> DataFrame:
    rest = F.crc32(F.col("id").cast("string")) % 7
    trains = F.coalesce(rest != 2, F.lit(True))
    scores = language_scores(table(spark, folder, "documents"), trains)
    return scores.select(
        F.col("id").alias("doc_id"),
        (~trains).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query
def op2_cube_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"), word_count("text"))
    return mixed.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


@query
def op3_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    spans = personal_spans(table(spark, folder, "documents"))
    return spans.select(
        F.col("id").alias("doc_id"),
        *(count_of(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)),
        F.sha2(written(F.filter("found", lambda f: f.base)), 256).alias("base_sha256"),
        written(F.col("kept")).alias("spans"),
    )


@query
def op4_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_boilerplate_lines",
        "n_boilerplate_words",
    )


@query
def op5_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    hits = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return hits.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op5_winnowing"] = r"""
with words_of as (
  select 'd' as kind, doc_id::varchar as id, row_number() over () as r, text from documents
  union all
  select 'i', item_id::varchar, row_number() over (), text from benchmark),
w as (
  select kind, id, r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from words_of),
sizes as (select distinct least(len(words), 10) as size from w where kind = 'i' and len(words) > 0),
items as (
  select distinct id as item, least(len(words), 10) as size, array_to_string(words[p : p + least(len(words), 10) - 1], ' ') as win
  from w, unnest(range(1, len(words) - least(len(words), 10) + 2)) as t(p)
  where kind = 'i' and len(words) > 0 and id is not null),
docs as (
  select r, size, p, array_to_string(words[p : p + size - 1], ' ') as win
  from w, sizes, unnest(range(1, len(words) - size + 2)) as t(p)
  where kind = 'd'),
hits as (select d.r, d.p, d.size, i.item from docs d join items i on d.size = i.size and d.win = i.win),
covered as (select r, count(distinct q) as n_hit from hits, unnest(range(p, p + size)) as t(q) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names
          from (select distinct r, item from hits) group by r)
select w.id::bigint as doc_id, len(w.words)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit,
  coalesce(n.n_items, 0)::bigint as n_items, sha256(coalesce(n.names, '')) as items_sha256,
  coalesce(c.n_hit, 0) > 0 as contaminated
from w left join covered c on w.r = c.r left join named n on w.r = n.r where w.kind = 'd'
"""


@query
def op6_byte_convolution(spark: SparkSession, folder: str) -> DataFrame:
    rest = F.crc32(F.col("id").cast("string")) % 3
    found = languages(table(spark, folder, "documents"), rest != 1)
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce(rest == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


@query
def op7_golay_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op8_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedupe_lines(table(spark, folder, "documents"))
    return kept.select(
        "doc_id",
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("kept_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query
def op9_prefix_doubling(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_digests(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@query
def op10_zip_archives(spark: SparkSession, folder: str) -> DataFrame:
    manifest = write_packages(table(spark, folder, "pages"))
    return resolved(read_packages(manifest, ensure_checkpoint_dir(spark), payloads=False)).select(
        "page_id",
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL["op10_zip_archives"] = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
                  sha1(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, payload_bytes, max(page_id) as first from p
      where payload_bytes >= 1000 group by all)
select p.page_id, p.payload_bytes::bigint as payload_bytes, p.payload_digest,
  case when f.first <> p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first <> p.page_id then f.first end as refers_to
from p left join f using (payload_digest, payload_bytes)
"""


@query
def op11_block_indexing(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(table(spark, folder, "documents"))


SQL["op11_block_indexing"] = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
t as (select r, lang, source, unnest(terms) as term from d),
k as (select lang, term, count(*) as c from t group by lang, term having count(distinct r) >= 3),
v as (select lang, count(*) as v, sum(c) as n from k group by lang),
c as (select t.lang, t.source, t.term, count(*) as c from t join k on t.lang = k.lang and t.term = k.term group by all),
g as (
  select s.lang, s.source, coalesce(v.v, 0) as v, coalesce(v.n, 0) as lang_n, coalesce(n.n, 0) as n
  from (select distinct lang, source from d) s left join v on s.lang = v.lang
  left join (select lang, source, sum(c) as n from c group by lang, source) n on s.lang = n.lang and s.source = n.source),
p as (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c,
    1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (g.n + g.v)::hugeint as p,
    1 + (1000000000::hugeint * (k.c + 1)) // (g.lang_n + g.v)::hugeint as whole
  from g join k on g.lang = k.lang left join c on g.lang = c.lang and g.source = c.source and k.term = c.term),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
items as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, ((p - whole) * (p - whole)) // whole from p where c > 0 and p > whole),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from items)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""


@query
def op12_large_item_matching(spark: SparkSession, folder: str) -> DataFrame:
    cut = pieces(table(spark, folder, "documents"), keep_ids=False).drop("ids")
    return pack(cut).withColumnRenamed("id", "doc_id")


@query
def op13_filter_potentials(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL["op13_filter_potentials"] = r"""
with d as (
  select coalesce(lang, '') as part, doc_id, text, min(doc_id) over (partition by coalesce(text, '')) as first,
    coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, len(w) < 200 as a,
    100 * len(list_distinct(w)) < 50 * len(w) as b,
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) as c,
    regexp_matches(t, '[#$%&*|]') as d, coalesce(d.doc_id > first, false) as e
  from d left join l on d.doc_id = l.doc_id),
m as (
  select part, a, b, c, d, e, count(*) as n, sum(good) as good, sum(toxic) as toxic
  from f group by part, a, b, c, d, e),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (
  select x1.x || x2.x || x3.x || x4.x || x5.x as o from x x1, x x2, x x3, x x4, x x5
  where len(list_distinct([x1.x, x2.x, x3.x, x4.x, x5.x])) = 5),
met as (
  select m.*, o, least(if(a, strpos(o, 'A'), 6), if(b, strpos(o, 'B'), 6), if(c, strpos(o, 'C'), 6),
    if(d, strpos(o, 'D'), 6), if(e, strpos(o, 'E'), 6)) as stop from m, o),
s as (
  select part, o as filter_order, step, substr(o, step, 1) as own, n, good, toxic, stop,
    case substr(o, step, 1) when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end as fails,
    a::int + b::int + c::int + d::int + e::int as n_fails
  from met, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (
  select part, filter_order, step, own, sum(if(stop > step, n, 0)) as kept, sum(if(stop = step, n, 0)) as removed,
    sum(if(fails and stop < step, n, 0)) as redundant, sum(if(fails and n_fails = 1, n, 0)) as unique_fails,
    sum(if(stop = step, good, 0)) as good_lost, sum(if(stop = step, toxic, 0)) as toxic_lost
  from s group by part, filter_order, step, own)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
  redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, sum(removed) over (partition by part, own)::bigint as shapley
from r
"""
