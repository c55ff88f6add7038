"""Checkpoints, the drops between them, and paging through a drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine import settings
from vitrine.functions.predicates import between
from vitrine.functions.text import rotation_seed
from vitrine.operators.ordinals import with_ordinals, with_running_total

# Checkpoints: label, watermark_ms, row_count.


def newest_checkpoints(checkpoints: DataFrame, limit: int | None) -> DataFrame:
    newest = checkpoints.orderBy(F.col("watermark_ms").desc(), F.col("label").desc())
    return newest if limit is None else newest.limit(limit)


def checkpoint_windows(
    checkpoints: DataFrame, lookup: int | None = settings.CHECKPOINT_LOOKUP
) -> DataFrame:
    """``(label, lo, hi)`` with ``lo`` the next older watermark, or 0.

    Only the newest ``lookup`` labels can be resolved; one more row is read so
    that the last of them still gets its true lower bound. ``lookup=None``
    resolves all. The checkpoint list is one short row per catalog run, and the
    limit below bounds what the one-partition window sees.
    """
    if lookup is None:
        return _all_windows(checkpoints)
    newest = newest_checkpoints(checkpoints, lookup + 1)
    order = Window.orderBy(F.col("watermark_ms").desc(), F.col("label").desc())
    return (
        newest.withColumn("lo", F.lead("watermark_ms", 1, 0).over(order))
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= lookup)
        .select("label", "lo", F.col("watermark_ms").alias("hi"))
    )


def _all_windows(checkpoints: DataFrame) -> DataFrame:
    """Windows of a list of any length, by joining neighbours on their ordinal."""
    placed = with_ordinals(
        checkpoints.select("label", "watermark_ms"), ["watermark_ms", "label"], "n"
    )
    older = placed.select((F.col("n") + 1).alias("n"), F.col("watermark_ms").alias("lo"))
    return placed.join(older, "n", "left").select(
        "label", F.coalesce("lo", F.lit(0)).cast("long").alias("lo"), F.col("watermark_ms").alias("hi")
    )


def resolve_labels(
    requests: DataFrame,
    checkpoints: DataFrame,
    lookup: int | None = settings.CHECKPOINT_LOOKUP,
) -> DataFrame:
    """Requests with ``lo``, ``hi``; ``known`` is false for an unknown label."""
    windows = checkpoint_windows(checkpoints, lookup)
    if lookup is not None and lookup <= settings.BROADCAST_LOOKUP_ROWS:
        windows = F.broadcast(windows)
    return requests.join(windows, "label", "left").withColumn("known", F.col("hi").isNotNull())


def in_window(docs: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows of one window; the comparison reaches the Parquet scan."""
    return docs.filter(between(F.col("upserted_at"), lo, hi))


def drop_membership(
    docs: DataFrame,
    checkpoints: DataFrame,
    time: str = "upserted_at",
    broadcast_limit: int = settings.BROADCAST_LOOKUP_ROWS,
) -> DataFrame:
    """Every row with the ``label`` of the drop it belongs to, NULL after the last.

    The range join is turned into an equi-join: time is cut into buckets of
    ``width`` and each drop is listed under the buckets it touches. Rows before
    the first watermark share its bucket. Up to ``broadcast_limit`` drops the list
    is broadcast and no row moves; beyond that the join shuffles on the bucket and
    adaptive execution splits a crowded one.
    """
    span = checkpoints.agg(
        F.min("watermark_ms").alias("first"),
        F.max("watermark_ms").alias("last"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if not span["n"]:
        return docs.withColumn("label", F.lit(None).cast("string"))
    few = span["n"] <= broadcast_limit
    windows = checkpoint_windows(checkpoints, broadcast_limit if few else None)
    # The mean gap: all drops together touch at most two buckets each on average.
    width = max(1, (span["last"] - span["first"]) // span["n"])
    first_bucket = span["first"] // width

    def bucket(c: Column) -> Column:
        return F.greatest(F.floor(c / width), F.lit(first_bucket))

    listed = windows.select(
        "label",
        "lo",
        "hi",
        F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))).alias("_bucket"),
    )
    if few:
        listed = F.broadcast(listed)
    keyed = docs.withColumn("_bucket", bucket(F.col(time)))
    match = (keyed["_bucket"] == listed["_bucket"]) & between(
        keyed[time], listed["lo"], listed["hi"]
    )
    return keyed.join(listed, match, "left").select(*[keyed[c] for c in docs.columns], "label")


def drop_ledger(checkpoints: DataFrame, limit: int = settings.DROPS_DEFAULT) -> DataFrame:
    """Newest drops with their counts and watermarks."""
    if not 1 <= limit <= settings.DROPS_MAX:
        raise ValueError(f"limit must be between 1 and {settings.DROPS_MAX}")
    return newest_checkpoints(checkpoints, limit).select(
        F.col("label").alias("run_id"),
        F.col("row_count").alias("product_count"),
        F.col("watermark_ms").alias("stable_as_of"),
    )


def recounted_ledger(docs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Every drop with the number of rows its window really holds."""
    counted = (
        drop_membership(docs, checkpoints)
        .filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    return checkpoints.join(counted, "label", "left").select(
        F.col("label").alias("run_id"),
        F.col("row_count").alias("product_count"),
        F.coalesce("found", F.lit(0)).alias("found_count"),
        F.col("watermark_ms").alias("stable_as_of"),
    )


# --- Keyset browsing ---


def browse_start(cursor: str | None) -> str | None:
    """Id after which a page starts; an empty cursor value is refused."""
    if not cursor:
        return None
    start = cursor.removeprefix("id:")
    if not start:
        raise ValueError("catalog browse cursor is empty")
    return start


def browse_page(
    docs: DataFrame, window: tuple[int, int], page_size: int, cursor: str | None = None
) -> DataFrame:
    """One page of a drop in id order, with ``next_cursor`` on its last row.

    One row more than the page is read; the cursor is set only if it is there.
    """
    start = browse_start(cursor)
    rows = in_window(docs, *window)
    if start is not None:
        rows = rows.filter(F.col("id") > start)
    probe = rows.orderBy("id").limit(page_size + 1)
    place = Window.orderBy("id")
    return (
        probe.withColumn("_place", F.row_number().over(place))
        .withColumn("_more", F.lead("id").over(place).isNotNull())
        .filter(F.col("_place") <= page_size)
        .withColumn(
            "next_cursor",
            F.when((F.col("_place") == page_size) & F.col("_more"), F.concat(F.lit("id:"), "id")),
        )
        .drop("_place", "_more")
    )


def browse_pages(docs: DataFrame, requests: DataFrame, page_size: int) -> DataFrame:
    """``(request_id, label, id, place, next_cursor)``: a page for every request.

    ``docs`` holds ``label`` and ``id`` (see ``drop_membership``); ``requests`` holds
    ``request_id``, ``label`` and ``after_id``, NULL for the first page. Documents
    and requests are put into one order by label and id. That gives each request
    the position its page starts at, and the page is fetched by position: work
    grows with the pages asked for, not with requests times documents.
    """
    spots = docs.filter(F.col("label").isNotNull()).select(
        "label", "id", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("request"), F.lit(1).alias("is_doc")
    )
    # A request stands right behind the id it continues from, or before all ids.
    asked = requests.select(
        "label",
        F.coalesce("after_id", F.lit("")).alias("id"),
        F.lit(1).alias("turn"),
        F.col("request_id").cast("string").alias("request"),
        F.lit(0).alias("is_doc"),
    )
    ordered = with_running_total(
        spots.unionByName(asked), ["label", "id", "turn", "request"], "is_doc", "upto"
    )
    numbered = ordered.filter(F.col("is_doc") == 1).select(
        F.col("upto").alias("spot"), F.col("label").alias("held"), "id"
    )
    wanted = ordered.filter(F.col("is_doc") == 0).select(
        F.col("request").alias("request_id"),
        "label",
        F.posexplode(F.sequence(F.col("upto") + 1, F.col("upto") + page_size + 1)).alias("step", "spot"),
    )
    found = wanted.join(numbered, "spot").filter(F.col("held") == F.col("label"))
    more = Window.partitionBy("request_id").orderBy("step")
    return (
        found.withColumn("_more", F.lead("id").over(more).isNotNull())
        .filter(F.col("step") < page_size)
        .select(
            "request_id",
            "label",
            "id",
            (F.col("step") + 1).alias("place"),
            F.when(
                (F.col("step") + 1 == page_size) & F.col("_more"), F.concat(F.lit("id:"), "id")
            ).alias("next_cursor"),
        )
    )


# --- Offset cursors ---

SCAN_CURSOR_SHAPE = r"^scan:([^:]+):(.+)$"


def offset_cursors(cursors: DataFrame, column: str = "cursor") -> DataFrame:
    """Parse offset cursors into ``scan_id``, ``offset`` and ``valid``.

    Accepted are nothing at all, ``scan:<id>:<offset>`` and a bare offset.
    """
    c = F.coalesce(F.col(column), F.lit(""))
    is_scan = c.startswith("scan:")
    digits = F.when(is_scan, F.regexp_extract(c, SCAN_CURSOR_SHAPE, 2)).otherwise(c)
    # A plus sign and blanks around the number are fine; it must not be negative.
    whole = F.when(digits.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(digits).try_cast("bigint"))
    number = F.when(c == "", F.lit(0).cast("bigint")).otherwise(
        F.when(whole >= 0, whole)
    )
    valid = number.isNotNull() & (~is_scan | c.rlike(SCAN_CURSOR_SHAPE))
    return (
        cursors.withColumn("valid", valid)
        .withColumn(
            "scan_id", F.when(valid & is_scan, F.regexp_extract(c, SCAN_CURSOR_SHAPE, 1))
        )
        .withColumn("offset", F.when(valid, number))
    )


def next_scan_cursor(scan_id: Column, offset: Column, returned: Column, total: Column) -> Column:
    """Cursor of the following page, NULL when the page was the last."""
    following = offset + returned
    return F.when(
        (returned > 0) & (following < total),
        F.concat(F.lit("scan:"), scan_id, F.lit(":"), following.cast("string")),
    )


# --- Rotation ---


def rotating_slice(docs: DataFrame, label: str, size: int, order: str = "id") -> DataFrame:
    """``size`` rows from a start that depends on the label, wrapping around."""
    placed = with_ordinals(docs, [order], "ordinal")
    total = placed.count()
    if not total:
        return placed.withColumn("place", F.col("ordinal"))
    start = rotation_seed(F.lit(label)).cast("long")
    turned = placed.withColumn("place", F.pmod(F.col("ordinal") - start % total, F.lit(total)))
    return turned.filter(F.col("place") < min(size, total))
