"""The batch job on hand-made exports with awkward rows."""

import csv
import gzip

import pytest
from pyspark.sql import functions as F

from lodgelens.operators import chunks, cleaning, ranking, sampling, views
from lodgelens.plans.medallion import Exports, Settings, TableSet, run_batch
from lodgelens.schemas import LISTINGS
from lodgelens.sources import csv_files, metric_state, query_sets, tables

BIG = 2**53 + 1


def write(path, header, rows, opener=open):
    with opener(path, "wt", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(header)
        writer.writerows(rows)
    return str(path)


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    base = tmp_path_factory.mktemp("exports")
    listings = write(
        base / "listings.csv",
        ["name", "id", "extra", "neighbourhood", "neighbourhood_group", "room_type", "price",
         "number_of_reviews", "latitude", "longitude"],
        [
            ["Casa\nBianca", 1, "x", " X Ostia/Acilia ", "North", "Entire", "$1,234.00", 9, 41.9, 12.5],
            ['The "Loft"', 2, "x", "IX Eur", "South", "Private", "$9.99", 8, 41.8, 12.4],
            ["Third", BIG, "x", "IX Eur", "South", "Private", "5000", 8, 41.8, ""],
            ["Fourth", 4, "x", "IX Eur", "South", "", "100", 7, "oops", 12.4],
            ["Fifth", 5, "x", "", "South", "Shared", "10", 1, 41.8, 12.4],
            ["Sixth", 6, "x", "IX Eur", "South", "Shared", "50", 0, 41.8, 12.4],
        ],
    )
    places = write(
        base / "neighbourhoods.csv",
        ["neighbourhood_group", "neighbourhood"],
        [["South", "IX Eur"], ["SOUTH", " ix eur"], ["North", "X Ostia/Acilia"]],
    )
    reviews = write(
        base / "reviews.csv.gz",
        ["listing_id", "id", "date", "reviewer_id", "reviewer_name", "comments"],
        [
            [1, 10, "2024-01-03", 7, "Ann", "The flat was<br/>very nice\nand the \"bed\" is good"],
            [1, 11, "2024-01-03", 7, "Ann", "the same guest and the same date, a later row"],
            [1, 12, "2024-01-02", 8, "Bob", "la casa è molto bella e il letto è comodo"],
            [1, 13, "2024-01-01", 9, "Cai", "die Wohnung ist sehr schön und nicht laut"],
            [2, 14, "2024-02-01", 9, "Cai", "the host is very kind and the flat was clean"],
            [BIG, 15, "2024-02-01", 9, "Cai", "it was a very nice stay in the city"],
            [6, 16, "2024-02-01", 9, "Cai", "never sampled as the listing has no reviews counted"],
            [5, 17, "2024-02-02", 9, "Cai", "<p> </p>"],
            [5, 18, "2024-02-01", 9, "Cai", "short"],
        ],
        gzip.open,
    )
    return Exports(listings=listings, reviews=reviews, neighbourhoods=places)


@pytest.fixture(scope="module")
def layers(spark, exports, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    return run_batch(spark, exports, TableSet(prefix="t_", folder=folder))


def test_bronze_by_name(layers):
    rows = {r["id"]: r for r in layers["bronze_listings"].collect()}
    assert rows[1]["name"] == "Casa\nBianca" and rows[2]["name"] == 'The "Loft"'
    assert rows[BIG]["longitude"] is None and rows[4]["latitude"] is None
    assert "extra" not in layers["bronze_listings"].columns
    assert rows[1]["host_id"] is None and rows[1]["city"] == "rome"
    assert rows[1]["ingestion_ts"] is not None
    assert set(LISTINGS.fieldNames()) < set(layers["bronze_listings"].columns)


def test_silver_listings(layers, rows):
    kept = layers["silver_listings"]
    assert rows(kept, "id", "price") == sorted([(1, 1234.0), (BIG, 5000.0), (5, 10.0), (6, 50.0)], key=repr)
    first = kept.filter("id = 1").first()
    assert first["neighbourhood"] == "x ostia/acilia"
    assert first["neighbourhood_display"] == " X Ostia/Acilia "


def test_silver_neighbourhoods_one_row_per_name(layers, rows):
    got = rows(layers["silver_neighbourhoods"], "neighbourhood", "neighbourhood_display")
    assert got == [("ix eur", " ix eur"), ("x ostia/acilia", "X Ostia/Acilia")]


def test_silver_reviews(layers, rows):
    got = rows(layers["silver_reviews"], "id", "lang")
    assert got == [(10, "en"), (12, "it"), (14, "en"), (15, "en")]
    text = layers["silver_reviews"].filter("id = 10").first()["comments"]
    assert text == 'The flat was very nice and the "bed" is good'


def test_gold_keeps_reviews_of_dropped_listings(layers, rows):
    got = rows(layers["gold_review_chunks"], "listing_id", "room_type")
    assert got == sorted([(1, "Entire"), (1, "Entire"), (2, None), (BIG, "Private")], key=repr)
    assert all(len(r["chunk_id"]) == 64 for r in layers["gold_review_chunks"].collect())


def test_enriched_view(spark, layers, rows):
    got = spark.sql("select id, official_neighbourhood_group from listings_enriched")
    assert (BIG, "south") in rows(got) and (5, None) in rows(got)
    located = views.reviewed_listings(layers["listings_enriched"], layers["gold_review_chunks"])
    assert rows(located, "id") == [("1",), (str(BIG),)]


def test_rerun_gives_the_same_keys(spark, exports, layers, tmp_path):
    again = run_batch(spark, exports, TableSet(prefix="u_", folder=str(tmp_path)))
    old = layers["gold_review_chunks"]
    assert chunks.snapshot_diff(old, again["gold_review_chunks"].select(old.columns)).count() == 0


def test_same_tables_twice(spark, exports, tmp_path):
    target = TableSet(prefix="w_", folder=str(tmp_path))
    first = {k: v.count() for k, v in run_batch(spark, exports, target).items()}
    assert first == {k: v.count() for k, v in run_batch(spark, exports, target).items()}


def test_sample_sizes(spark, exports, tmp_path):
    small = run_batch(
        spark,
        exports,
        TableSet(prefix="v_", folder=str(tmp_path)),
        Settings(reviews_per_listing=1, listings_per_place=1),
    )
    sampled = small["bronze_reviews"]
    # One listing per raw place name: 1, 2 (ahead of BIG by id) and 5, one review each.
    assert sorted(r["id"] for r in sampled.collect()) == [10, 14, 17]


def test_headers_must_agree_between_files(spark, tmp_path):
    write(tmp_path / "a.csv", ["x", "y"], [[1, 2]])
    write(tmp_path / "b.csv", ["y", "x"], [[3, 4]])
    with pytest.raises(Exception, match="(?i)header"):
        csv_files.scan_csv(spark, str(tmp_path)).collect()


def test_required_columns(spark):
    df = spark.range(1)
    assert tables.require_columns(df, "id") is df
    with pytest.raises(ValueError, match="comments"):
        tables.require_columns(df, "comments")


def test_salted_ranking_equals_plain_window(spark):
    df = spark.range(5000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        (F.col("id") * 7 % 11).alias("v"),
    )
    deep = ranking.top_per_key(df, ["k"], [F.desc("v")], 150, tie="id")
    window = "row_number() over (partition by k order by v desc, id)"
    plain = df.withColumn("rank", F.expr(window)).filter("rank <= 150")
    assert sorted(map(tuple, deep.collect())) == sorted(map(tuple, plain.collect()))


def test_null_keys_form_one_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, k string")
    assert ranking.top_per_key(df, ["k"], [F.desc("id")], 1, tie="id").count() == 2


def test_sampling_is_bounded(spark):
    listings = spark.read.parquet("/root/testdata/sf0.001/part.parquet").selectExpr(
        "p_partkey id", "p_brand neighbourhood", "p_size number_of_reviews"
    )
    reviews = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr(
        "l_partkey listing_id", "l_orderkey id", "cast(l_shipdate as string) date"
    )
    sample = sampling.stratified_reviews(listings, reviews, 2, 3)
    places = listings.select("neighbourhood").distinct().count()
    assert sample.count() <= places * 2 * 3
    assert sample.groupBy("listing_id").count().agg(F.max("count")).first()[0] <= 3


def test_dedup_is_idempotent(spark, layers):
    once = cleaning.silver_reviews(layers["bronze_reviews"])
    twice = ranking.keep_first(once, ["listing_id", "reviewer_id", "date"], [F.col("id")])
    assert once.count() == twice.count()


def test_snapshot_diff_sees_null_changes(spark, rows):
    kind = "chunk_id string, t string, u string, n int"
    old = spark.createDataFrame(
        [("a", None, "", 1), ("b", "x", "", 2), ("c", "y", "", 3), ("e", "v", None, 4)], kind
    )
    new = spark.createDataFrame(
        [("a", "now", "", 1), ("b", "x", "", 2), ("d", None, None, None), ("e", None, "v", 4)], kind
    )
    got = rows(chunks.snapshot_diff(old, new), "chunk_id", "_change_type")
    assert got == [("a", "update"), ("c", "delete"), ("d", "insert"), ("e", "update")]
    assert chunks.snapshot_diff(new, new).count() == 0


def test_query_set_files(spark, tmp_path, rows):
    (tmp_path / "set.json").write_text(
        '{"_comment": "c", "queries": [{"id": "q1", "query": "a", "relevant_listing_ids": ["9.0", "9"]},'
        ' {"id": "q2", "query": "b", "relevant_listing_ids": []}]}'
    )
    queries, labels = query_sets.read_query_set(spark, str(tmp_path))
    assert rows(queries) == [("q1", "a"), ("q2", "b")]
    assert rows(labels) == [("q1", "9")]


def test_metric_state_object(spark, tmp_path, rows):
    (tmp_path / "m.json").write_text(
        '{"intent_counts": {"rag": 2}, "cache_hits": 1, "cache_misses": 3, "errors": {"chat": 1},'
        ' "phase_timings": {"generate": [1.5, 2.5]}}'
    )
    got = rows(metric_state.load_state_object(spark, str(tmp_path)))
    assert got == sorted(
        [("intent", "rag", 1, 2.0), ("error", "chat", 1, 1.0), ("cache", "hit", 1, 1.0),
         ("cache", "miss", 1, 3.0), ("phase", "generate", 1, 1.5), ("phase", "generate", 2, 2.5)],
        key=repr,
    )
