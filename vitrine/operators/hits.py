"""Hit rows of different shapes brought into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import coerce as C

# Keys of a flat row that are not attributes; so is any key starting with "$".
ROW_KEYS = ("id", "$dist", "dist", "vector")


def hits_from_rows(rows: DataFrame, raw: str = "row") -> DataFrame:
    """``(id, dist, attributes)`` from flat JSON rows in text column ``raw``.

    An ``attributes`` object in the row is used as it is. Otherwise every other
    key that is not part of the row itself counts as an attribute.
    """
    parsed = rows.select(F.try_parse_json(F.col(raw)).alias("v")).select(
        C.field("v", "id").alias("doc_id"),
        F.expr(C.object_sql("v")).alias("fields"),
        F.expr(C.object_sql(C.field_sql("v", "attributes"))).alias("nested"),
    )
    # "$dist" wins over "dist" as soon as the key is there.
    placed = parsed.withColumn(
        "far",
        F.expr(
            "case when map_contains_key(fields, '$dist') then try_element_at(fields, '$dist')"
            " else try_element_at(fields, 'dist') end"
        ),
    )
    own = F.map_filter("fields", lambda k, _x: ~k.isin(*ROW_KEYS) & ~k.startswith("$"))
    number = f"case when {C.kind_sql('far')} not in ('STRING', 'BOOLEAN', 'VOID') then try_cast({C.text_sql('far')} as double) end"
    return placed.select(
        F.expr(f"coalesce({C.truthy_text_sql('doc_id')}, '')").alias("id"),
        F.expr(number).alias("dist"),
        F.coalesce("nested", own).alias("attributes"),
    ).withColumn(
        "attributes",
        F.expr(
            f"coalesce(transform_values(attributes, (k, x) -> {C.text_sql('x')}),"
            " cast(map() as map<string,string>))"
        ),
    )


def hits_from_results(results: DataFrame) -> DataFrame:
    """The structured shape: ``id``, ``dist`` and an ``attributes`` text map."""
    return results.select(
        F.col("id").cast("string").alias("id"),
        F.col("dist").cast("double").alias("dist"),
        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
    )


def all_hits(rows: DataFrame, results: DataFrame) -> DataFrame:
    return hits_from_rows(rows).unionByName(hits_from_results(results))
