"""Text, label and reference expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine import settings


def strip(c: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of whitespace become one blank; ends are trimmed; blank is NULL."""
    return blank_to_null(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def fold_case(c: Column) -> Column:
    """Case folding; sharp s is the only multi-character fold handled."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalize_query(c: Column) -> Column:
    """Aggregation key of a raw query, NULL when empty or over-long."""
    key = collapse(fold_case(c))
    return F.when(F.length(key) <= settings.MAX_QUERY_CHARS, key)


def tokens(c: Column) -> Column:
    """Lower-case ASCII letter/digit runs longer than one character."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def document_text(title: Column, description: Column) -> Column:
    return F.concat_ws("\n", blank_to_null(title), blank_to_null(description))


def trending_row_id(query: Column) -> Column:
    return F.concat(F.lit("trend:"), F.substring(F.sha2(query, 256), 1, 16))


def percent_encode(c: Column) -> Column:
    """RFC 3986 escaping with no character kept safe beyond the unreserved ones."""
    plain = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    plain = F.replace(plain, F.lit("*"), F.lit("%2A"))
    return F.replace(plain, F.lit("%7E"), F.lit("~"))


def percent_decode(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def drop_label(day: Column) -> Column:
    return F.concat(F.lit("catalog-"), F.date_format(day, "yyyy-MM-dd"))


def drop_label_or_default(label: Column, today: Column) -> Column:
    """A given label, or the label of ``today`` where it is missing or blank."""
    return F.coalesce(blank_to_null(strip(label)), drop_label(today))


def drop_date(label: Column) -> Column:
    """Date coded in a drop label, NULL for any other text."""
    shape = r"^catalog-(\d{4}-\d{2}-\d{2})$"
    return F.when(
        label.rlike(shape), F.regexp_extract(label, shape, 1).try_cast("date")
    )


def rotation_seed(c: Column) -> Column:
    """Polynomial hash over the characters, starting at 0."""
    return F.aggregate(
        F.filter(F.split(c, ""), lambda ch: ch != ""),
        F.lit(0),
        lambda h, ch: (h * settings.SEED_FACTOR + F.ascii(ch)) % settings.SEED_MODULUS,
    )


def blob_ref(namespace: str, digest: Column) -> Column:
    return F.concat(F.lit(f"blob://{namespace}/"), digest)


BLOB_REF_SHAPE = r"^blob://([^/]+)/([0-9a-fA-F]{64})$"


def blob_ref_digest(ref: Column) -> Column:
    """Lower-case digest of a well-formed reference, else NULL."""
    ref = strip(ref)
    return F.when(
        ref.rlike(BLOB_REF_SHAPE), F.lower(F.regexp_extract(ref, BLOB_REF_SHAPE, 2))
    )


def blob_ref_status(ref: Column) -> Column:
    """``none`` for no reference, ``ok`` for a well-formed one, else ``invalid``."""
    clean = strip(F.coalesce(ref, F.lit("")))
    return (
        F.when(clean == "", "none")
        .when(clean.rlike(BLOB_REF_SHAPE), "ok")
        .otherwise("invalid")
    )
