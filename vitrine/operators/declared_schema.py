"""Declared attribute schema of the product table and its checks."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrine import settings
from vitrine.functions.predicates import predicate

FILTERABLE = ("category",)
TEXT_SEARCHABLE = ("title",)
# Columns every stored row has beside its declared attributes.
UNDECLARED = ("id", "vector", "upserted_at")

PRODUCT_TABLE = T.StructType(
    [
        T.StructField(
            name,
            T.StringType(),
            True,
            {"filterable": name in FILTERABLE, "fts": name in TEXT_SEARCHABLE},
        )
        for name in settings.PRODUCT_ATTRIBUTES
    ]
)


def apply_schema(df: DataFrame, declared: T.StructType = PRODUCT_TABLE) -> DataFrame:
    """Cast declared attributes, attach their flags and keep the row columns."""
    kept = [df[c] for c in UNDECLARED if c in df.columns]
    typed = [
        df[f.name].cast(f.dataType).alias(f.name, metadata=f.metadata)
        for f in declared.fields
        if f.name in df.columns
    ]
    return df.select(*kept, *typed)


def violations(df: DataFrame, declared: T.StructType = PRODUCT_TABLE) -> list[str]:
    """Declared attributes that are absent or of another type."""
    held = {f.name: f.dataType for f in df.schema.fields}
    return [
        f.name for f in declared.fields if held.get(f.name, T.NullType()) != f.dataType
    ]


def filterable(declared: T.StructType = PRODUCT_TABLE) -> set[str]:
    names = {f.name for f in declared.fields if f.metadata.get("filterable")}
    return names | {"id", "upserted_at"}


def checked_filter(
    df: DataFrame, tree: Sequence[Any] | None, declared: T.StructType = PRODUCT_TABLE
) -> DataFrame:
    """Filter by a tree that may only use filterable attributes."""
    return df if tree is None else df.filter(predicate(tree, filterable(declared)))
