"""Product normalisation and the projections of a product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import settings
from vitrine.functions import coerce as C
from vitrine.functions.text import blank_to_null, document_text
from vitrine.operators.tables import SEQUENCE

PRODUCT_SCHEMA = T.StructType(
    [
        T.StructField("asin", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("image_url", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("avg_rating", T.DoubleType()),
        T.StructField("rating_count", T.LongType()),
    ]
)


# Fields read from a raw row, and the second name of those that have one.
FALLBACKS = {
    "parent_asin": "asin",
    "description": "features",
    "average_rating": "avg_rating",
    "rating_number": "rating_count",
}
RAW_FIELDS = ("images", "title", "price", *FALLBACKS, *FALLBACKS.values())


def normalize_products(rows: DataFrame, raw: str = "v", keep: list[str] | None = None) -> DataFrame:
    """Typed products of raw rows held in the VARIANT column ``raw``.

    ``category`` must already be a column. Rows without an id or an image are
    dropped. ``keep`` names further columns to carry along.
    """
    carried = [F.col(c) for c in [*(keep or []), "category"]]
    # Steps are separate projections so that each value is worked out once.
    fields = rows.select(*carried, *[C.field(raw, name).alias(name) for name in RAW_FIELDS])
    chosen = fields.select(
        *carried,
        "images",
        "title",
        "price",
        *[
            C.either(first, second).alias(first)
            for first, second in FALLBACKS.items()
        ],
    )
    typed = chosen.select(
        *[F.col(c) for c in keep or []],
        C.first_text("parent_asin").alias("asin"),
        "category",
        C.pick_image_url("images").alias("image_url"),
        C.first_text("title").alias("title"),
        C.first_text("description").alias("description"),
        C.coerce_float("price").alias("price"),
        C.coerce_float("average_rating").alias("avg_rating"),
        C.coerce_int("rating_number").alias("rating_count"),
    )
    return drop_rows_without(typed, "asin", "image_url")


def drop_rows_without(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where all ``columns`` are set.

    A plain filter would be pushed below the projection and evaluate the long
    expressions behind the columns a second time; a generator that yields one
    row or none stays where it is written.
    """
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    once = F.explode(F.when(present, F.array(F.lit(1))))
    return df.select(*df.columns, once.alias("_kept")).drop("_kept")


def sparse_attributes(products: DataFrame) -> Column:
    """Struct of the attributes; empty text becomes NULL, so JSON omits it."""
    texts = ("asin", "category", "image_url", "image_blob", "title", "description")
    numbers = ("price", "avg_rating", "rating_count")
    held = set(products.columns)
    return F.struct(
        *[blank_to_null(F.col(c)).alias(c) for c in texts if c in held],
        *[F.col(c) for c in numbers if c in held],
    )


def stage_chunks(products: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """One ``(id, text, metadata)`` chunk per product.

    With ``order``, the order of the source, chunks carry their place in it as
    ``sequence``, so that the last of several chunks of one id can be told.
    """
    place = [F.struct(*order).alias(SEQUENCE)] if order else []
    return products.select(
        F.col("asin").alias("id"),
        document_text(F.col("title"), F.col("description")).alias("text"),
        sparse_attributes(products).alias("metadata"),
        *place,
    )


def vector_attributes(chunks: DataFrame) -> DataFrame:
    """Attributes stored next to a vector, all text, from staged chunks."""
    held = set(chunks.schema["metadata"].dataType.fieldNames())

    def meta(name: str) -> Column:
        return F.col(f"metadata.{name}") if name in held else F.lit(None)

    return chunks.select(
        "id",
        F.coalesce(blank_to_null(meta("asin").cast("string")), F.col("id")).alias("asin"),
        *[meta(c).cast("string").alias(c) for c in settings.VECTOR_TEXT_ATTRIBUTES],
        meta("avg_rating").cast("string").alias("avg_rating_txt"),
        meta("rating_count").cast("string").alias("rating_cnt_txt"),
    )


def project_attributes(df: DataFrame, include: list[str] | None = None) -> DataFrame:
    """``id`` and the wanted attributes; all columns when none are named."""
    if not include:
        return df
    return df.select("id", *[c for c in include if c in df.columns and c != "id"])


def cards(docs: DataFrame) -> DataFrame:
    """Display rows: absent text is empty, absent ratings are 0, no price."""

    def text(name: str) -> Column:
        if name not in docs.columns:
            return F.lit("")
        return F.coalesce(F.col(name), F.lit(""))

    return docs.select(
        F.coalesce(blank_to_null(text("asin")), F.col("id")).alias("asin"),
        *[text(c).alias(c) for c in ("title", "description", "category", "image_url")],
        blank_to_null(text("image_blob")).alias("image_blob"),
        F.lit(None).cast("double").alias("price"),
        C.rating_number("avg_rating_txt").alias("rating"),
        C.rating_number("rating_cnt_txt").alias("rating_count"),
    )
