from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vitrine.functions import coerce as C
from vitrine.functions import text as X
from vitrine.operators import declared_schema, embedding, hits, products, slices, tables
from vitrine.plans import ingest_job
from vitrine.sources import catalog
from vitrine.sources.versioned import VersionedTable


def variants(spark, values):
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, j string").select(
        "i", F.parse_json("j").alias("v")
    )


def values_of(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_coerce_float(spark):
    given = ["$19.99", "1,234.5", "", "None", None, 7, 2.5, True, "abc", [1], "1d", " 12 ", "inf"]
    wanted = [19.99, 1234.5, None, None, None, 7.0, 2.5, None, None, None, None, 12.0, float("inf")]
    assert values_of(variants(spark, given), C.coerce_float("v")) == wanted


def test_coerce_int(spark):
    given = ["1,234", "4.9", "-4.9", "", "None", None, 12, 3.7, "x", "inf"]
    wanted = [1234, 4, -4, None, None, None, 12, 3, None, None]
    assert values_of(variants(spark, given), C.coerce_int("v")) == wanted


def test_first_text(spark):
    given = ["  a  ", "", ["Small", " ", "Waterproof", "x", "y"], [], [" "], None, 5, True, [1, None, "z"], {"b": 1}]
    wanted = ["a", None, "Small Waterproof x", None, None, None, "5", "True", "1 None z", "b"]
    assert values_of(variants(spark, given), C.first_text("v")) == wanted


def test_pick_image_url(spark):
    given = [
        [{"thumb": "t1"}, {"hi_res": "h2", "large": "l2"}],
        [{"large": None, "thumb": "t"}, {"large": "l"}],
        {"hi_res": "", "large": ["", None, "l"], "thumb": "t"},
        "http://plain",
        "",
        None,
        [],
        ["", "http://in-list"],
        [None, ["http://nested"]],
        [{"other": "x"}],
        {"url": 0, "thumb": "t"},
        7,
        [[[["http://four"]]]],
        [[[[["", [{"thumb": "t6"}, [{"hi_res": "h7"}], {"large": "l6"}]]]]], "later"],
        [[], [[]], [None, 0], [[{"other": 1}], "after, [all]"]],
        [["first"], [{"hi_res": "second"}], {"thumb": "own"}],
        [[[], [[""]]]],
    ]
    wanted = ["h2", "l", "l", "http://plain", None, None, None, "http://in-list", "http://nested", None, "t", None]
    wanted += ["http://four", "l6", "after, [all]", "own", None]
    assert values_of(variants(spark, given), C.pick_image_url("v")) == wanted


def test_lenient_values(spark):
    given = [True, 5, 4.9, "7", "7.5", " 8 ", None, [1], "x"]
    found = variants(spark, given)
    assert values_of(found, C.lenient_int("v")) == [0, 5, 4, 7, 0, 8, 0, 0, 0]
    assert values_of(found, C.lenient_float("v")) == [0.0, 5.0, 4.9, 7.0, 7.5, 8.0, 0.0, 0.0, 0.0]
    lists = variants(spark, [["a", 1, None, "b"], "a", None])
    assert values_of(lists, C.text_items("v")) == [["a", "b"], [], []]


def raw(spark, *rows):
    lines = [(i, "Cameras", json.dumps(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(lines, "n int, category string, j string").select(
        "n", "category", F.parse_json("j").alias("v")
    )


CAMERA = {
    "parent_asin": "B0123",
    "title": "Camera",
    "description": ["Small", "Waterproof"],
    "price": "$19.99",
    "average_rating": "4.5",
    "rating_number": "1,234",
    "images": [{"large": "http://large"}],
}


def test_product_from_row(spark):
    got = products.normalize_products(raw(spark, CAMERA)).first().asDict()
    assert got == {
        "asin": "B0123",
        "category": "Cameras",
        "image_url": "http://large",
        "title": "Camera",
        "description": "Small Waterproof",
        "price": 19.99,
        "avg_rating": 4.5,
        "rating_count": 1234,
    }


def test_fallback_columns_use_truthiness(spark):
    row = {
        "parent_asin": "",
        "asin": " A1 ",
        "images": "u",
        "description": [],
        "features": ["f"],
        "average_rating": 0,
        "avg_rating": 3,
        "rating_number": None,
        "rating_count": 6,
    }
    got = products.normalize_products(raw(spark, row)).first()
    assert (got["asin"], got["description"], got["avg_rating"], got["rating_count"]) == ("A1", "f", 3.0, 6)


def test_rows_without_id_or_image_are_dropped(spark):
    rows = [{**CAMERA, "parent_asin": None}, {**CAMERA, "images": []}, CAMERA]
    assert products.normalize_products(raw(spark, *rows)).count() == 1


def test_normalisation_evaluates_each_value_once(spark):
    """The row filter must not be pushed below the projection that feeds it."""
    plan = products.normalize_products(raw(spark, CAMERA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan
    assert plan.count("Filter") == 0


def test_chunks_and_vector_attributes(spark):
    chunk = products.stage_chunks(products.normalize_products(raw(spark, CAMERA)))
    got = chunk.first()
    assert (got["id"], got["text"]) == ("B0123", "Camera\nSmall Waterproof")
    attrs = products.vector_attributes(chunk).first()
    assert (attrs["avg_rating_txt"], attrs["rating_cnt_txt"], attrs["image_blob"]) == ("4.5", "1234", None)


def test_vector_attributes_fall_back_to_id(spark):
    chunk = spark.createDataFrame(
        [("D1", (None, "t", 3.5, 6, "run"))],
        "id string, metadata struct<asin:string,title:string,avg_rating:double,rating_count:long,catalog_run_id:string>",
    )
    got = products.vector_attributes(chunk)
    assert "catalog_run_id" not in got.columns
    assert got.first()["asin"] == "D1"


def test_cards_defaults(spark):
    docs = spark.createDataFrame(
        [("D1", None, "x", "nan", None)],
        "id string, asin string, title string, avg_rating_txt string, rating_cnt_txt string",
    )
    got = products.cards(docs).first()
    assert got.asDict() == {
        "asin": "D1", "title": "x", "description": "", "category": "", "image_url": "",
        "image_blob": None, "price": None, "rating": 0.0, "rating_count": 0.0,
    }


# --- Sources ---


def test_source_names(spark):
    names = spark.createDataFrame(
        [(0, "Cell Phones"), (1, "raw_meta_Books"), (2, " Electronics ")], "pos int, category string"
    )
    files = catalog.category_files(names, "feature/test").orderBy("pos").collect()
    assert [r["domain"] for r in files] == ["Cell_Phones", "Books", "Electronics"]
    assert files[2]["file"] == "meta_Electronics.feature_test.jsonl"


def test_read_categories(spark, tmp_path):
    (tmp_path / "meta_Cell_Phones.main.jsonl").write_text(
        json.dumps(CAMERA) + "\n\n" + json.dumps({**CAMERA, "parent_asin": "B2", "images": "u"}) + "\n"
    )
    (tmp_path / "meta_Books.main.jsonl").write_text(json.dumps({**CAMERA, "parent_asin": "B3"}) + "\n")
    rows = catalog.read_categories(spark, str(tmp_path), ["Cell Phones", "Books"])
    got = products.normalize_products(rows)
    assert {(r["asin"], r["category"]) for r in got.collect()} == {
        ("B0123", "Cell Phones"), ("B2", "Cell Phones"), ("B3", "Books"),
    }
    totals = {r["category"]: r["row_count"] for r in catalog.category_counts(got).collect()}
    assert totals == {"Cell Phones": 2, "Books": 1, None: 3}


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        catalog.read_catalog(spark, str(tmp_path / "bad.jsonl")).select(
            F.try_variant_get("v", "$.a", "int")
        ).collect()


def test_resolve_categories(spark):
    given = ["Electronics", "Home and Kitchen", "electronics", "Books", ""]
    assert catalog.resolve_categories(spark, given, None, "x") == ["Electronics", "Home and Kitchen", "Books"]
    assert catalog.resolve_categories(spark, None, None, "Books") == ["Books"]
    assert catalog.resolve_categories(spark, None, " Toys ", "Books") == ["Toys"]
    assert catalog.resolve_categories(spark, [], None, "Books") == []


# --- Slices ---


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "category string, row_offset long, count long")


def planned(df):
    return sorted((r["row_offset"], r["row_limit"]) for r in df.collect())


def test_plan_slices(spark):
    assert planned(slices.plan_slices(requests(spark, ("c", 5, 3)), 2)) == [(5, 2), (7, 1)]
    assert planned(slices.plan_slices(requests(spark, ("c", 0, 0)), 2)) == []
    assert planned(slices.plan_slices(requests(spark, ("c", 4, -1)), 2)) == [(4, -1)]
    with pytest.raises(Exception, match="out of range"):
        slices.plan_slices(requests(spark, ("c", 0, -2)), 2).collect()
    with pytest.raises(Exception, match="out of range"):
        slices.plan_slices(requests(spark, ("c", -1, 2)), 2).collect()
    with pytest.raises(ValueError):
        slices.plan_slices(requests(spark), 0)


def test_refresh_ids(spark):
    df = spark.createDataFrame([("catalog 2024/a+b~c*",)], "label string")
    coded = df.select("label", slices.refresh_id(F.col("label")).alias("id"))
    got = coded.select("id", slices.refresh_label(F.col("id")).alias("label")).first()
    assert got["id"] == "refresh:catalog%202024%2Fa%2Bb~c%2A"
    assert got["label"] == "catalog 2024/a+b~c*"
    assert spark.range(1).select(slices.refresh_label(F.lit("index:x"))).first()[0] is None


def test_take_slice(spark, rows):
    numbered = slices.numbered(spark.range(0, 50, 3).withColumnRenamed("id", "n"), ["n"])
    taken = slices.take_slice(numbered, 2, 3).orderBy("n")
    assert rows(taken) == [(6, 2), (9, 3), (12, 4)]
    assert slices.take_slice(numbered, -5, -1).count() == 17
    assert slices.take_slice(numbered, 0, 0).count() == 0


# --- Tables ---


def test_upsert_and_replace(spark, rows):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "id string, n int")
    merged = tables.upsert(target, new, version=[F.col("n").desc()])
    assert sorted(rows(merged.select("id", "n"))) == [("a", 1), ("b", 4), ("c", 5)]
    replaced = tables.upsert(target, new, version=[F.col("n").desc()], mode="replace")
    assert sorted(rows(replaced.select("id", "n"))) == [("b", 4), ("c", 5)]
    with pytest.raises(ValueError):
        tables.upsert(target, new, mode="append")


def test_merge_needs_a_capable_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    rows.createOrReplaceTempView("plain_rows")
    with pytest.raises(Exception, match="(?i)merge|not supported|unsupported"):
        tables.merge_into(rows, "plain_rows")


def test_patch_sets_null_too(spark, rows):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    patch = spark.createDataFrame([("b", None), ("z", 9)], "id string, n int")
    assert sorted(rows(tables.patch_columns(target, patch))) == [("a", 1, "x"), ("b", None, "y")]


def test_fetch_by_ids(spark, rows):
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    ids = spark.createDataFrame([(" a ",), ("a",), ("z",), ("",)], "id string")
    got = tables.fetch_by_ids(docs, ids)
    assert sorted(rows(got)) == [("a", 1, True), ("z", None, False)]


def test_versioned_table(spark, rows, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([("a", 1)], "id string, n int")
    assert not table.exists()
    assert table.upsert(one.limit(0)) is None
    assert table.upsert(one) == 0
    assert table.upsert(spark.createDataFrame([("b", 2)], "id string, n int")) == 1
    assert table.patch(spark.createDataFrame([("a", 7)], "id string, n int")) == 2
    assert sorted(rows(table.read().select("id", "n"))) == [("a", 7), ("b", 2)]
    assert rows(table.read(0).select("id", "n")) == [("a", 1)]
    (tmp_path / "t" / "v=0000000003").mkdir()
    assert table.versions() == [0, 1, 2]


def test_declared_schema(spark):
    docs = spark.createDataFrame([("a", "t", 5)], "id string, title string, avg_rating_txt int")
    typed = declared_schema.apply_schema(docs)
    assert typed.schema["avg_rating_txt"].dataType.simpleString() == "string"
    assert typed.schema["title"].metadata == {"filterable": False, "fts": True}
    assert "avg_rating_txt" in declared_schema.violations(docs)
    assert "title" not in declared_schema.violations(docs)
    with pytest.raises(ValueError, match="not filterable"):
        declared_schema.checked_filter(typed, ["title", "Eq", "t"])
    with pytest.raises(ValueError, match="comparison"):
        declared_schema.checked_filter(typed, ["id", "Like", "t"])


def test_hit_shapes(spark):
    flat = spark.createDataFrame(
        [
            ('{"id": 5, "$dist": 0.5, "dist": 9, "vector": [1], "$x": 1, "title": "T"}',),
            ('{"id": "a", "dist": 0.25, "attributes": {"k": "v"}, "title": "T"}',),
            ('{"$dist": null, "dist": 3}',),
            ("[1]",),
        ],
        "row string",
    )
    got = [(r["id"], r["dist"], r["attributes"]) for r in hits.hits_from_rows(flat).collect()]
    assert got == [("5", 0.5, {"title": "T"}), ("a", 0.25, {"k": "v"}), ("", None, {}), ("", None, {})]


# --- Labels and references ---


def test_drop_labels(spark):
    df = spark.createDataFrame(
        [("catalog-2024-02-29",), ("catalog-2023-02-29",), ("x-2024-01-01",), ("catalog-2024-01-01 ",)], "l string"
    )
    got = [str(r[0]) for r in df.select(X.drop_date(F.col("l"))).collect()]
    assert got == ["2024-02-29", "None", "None", "None"]


def test_blob_refs(spark):
    good = "a" * 64
    df = spark.createDataFrame(
        [(f"blob://ns/{good.upper()}",), (f"blob://ns/x/{good}",), ("blob://ns/abc",), (None,), ("  ",), (f"blob:///{good}",)],
        "r string",
    )
    status = [r[0] for r in df.select(X.blob_ref_status(F.col("r"))).collect()]
    assert status == ["ok", "invalid", "invalid", "none", "none", "invalid"]
    assert df.select(X.blob_ref_digest(F.col("r"))).first()[0] == good


# --- Embedding ---


def test_triage(spark):
    claims = spark.createDataFrame([("ok",), ("nochunk",), ("nourl",), ("unread",)], "id string")
    chunks = spark.createDataFrame(
        [("ok", ("u",)), ("nourl", (" ",)), ("unread", ("u",))], "id string, metadata struct<image_url:string>"
    )
    errors = spark.createDataFrame([("unread",)], "id string")
    got = {r["id"]: r["outcome"] for r in embedding.triage(claims, chunks, errors).collect()}
    assert got == {"ok": "ready", "nochunk": "failed", "nourl": "failed", "unread": "retry"}


def test_failed_image_returns_its_micro_batch(spark):
    rows = spark.createDataFrame([(f"i{n}", bytes([n + 1])) for n in range(5)] + [("i5", b"")], "id string, content binary").coalesce(1)
    got = {r["id"]: r["outcome"] for r in embedding.embed_images(rows, embedding.hashed_bytes_encoder(8), 2).collect()}
    assert got == {"i0": "ok", "i1": "ok", "i2": "ok", "i3": "ok", "i4": "retry", "i5": "retry"}


def test_failing_model_is_a_retry(spark):
    def broken():
        def encode(images):
            raise RuntimeError("out of memory")

        return encode

    rows = spark.createDataFrame([("a", b"x")], "id string, content binary")
    got = embedding.embed_images(rows, broken).first()
    assert (got["vector"], got["outcome"]) == (None, "retry")


def test_ingest_end_to_end(spark, tmp_path):
    more = [{**CAMERA, "parent_asin": f"B{n}", "images": f"http://img/{n}"} for n in range(4)]
    rows = raw(spark, *more)
    table = VersionedTable(spark, str(tmp_path / "products"))

    def fetch(url):
        if url.endswith("3"):
            raise OSError("gone")
        return url.encode()

    first = ingest_job.stage(rows, ["n"], 0, 2)
    got = ingest_job.embed_and_index(table, first, fetch, embedding.hashed_bytes_encoder(8), "ns", 10, str(tmp_path / "blobs"))
    assert {(r["id"], r["outcome"]) for r in got.collect()} == {("B0", "ok"), ("B1", "ok")}
    rest = ingest_job.stage(rows, ["n"], indexed=table.read())
    got = ingest_job.embed_and_index(table, rest, fetch, embedding.hashed_bytes_encoder(8), "ns", 20, str(tmp_path / "blobs"))
    # B2 shares its micro-batch with the image that is gone.
    assert {r["outcome"] for r in got.collect()} <= {"ok", "retry"}
    stored = {r["id"]: r for r in table.read().collect()}
    assert {"B0", "B1"} <= set(stored) and "B3" not in stored
    assert stored["B0"]["image_blob"].startswith("blob://ns/") and stored["B0"]["upserted_at"] == 10
    assert sum(x * x for x in stored["B0"]["vector"]) == pytest.approx(1.0, abs=1e-5)
