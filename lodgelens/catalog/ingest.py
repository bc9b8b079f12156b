"""Sources, sinks and plain projections and filters."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from lodgelens.catalog.registry import load, query
from lodgelens.functions.text import normalise_name
from lodgelens.functions.values import range_to_null
from lodgelens.operators import chunks as chunk_ops
from lodgelens.operators import questions, request_log, views
from lodgelens.operators.filters import filter_route
from lodgelens.operators.versions import VersionedTable
from lodgelens.schemas import flat_schema
from lodgelens.session import scratch_path
from lodgelens.sources import csv_files, metric_state, query_sets, tables
from lodgelens.sources.csv_split import scan_csv_split


@query(
    "csv_scan",
    """
    SELECT p_partkey, p_name || chr(10) || '"' || p_brand || '", ' || p_type AS note, p_retailprice
    FROM part
    """,
)
def csv_scan(spark, folder):
    note = F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", '), "p_type").alias("note")
    path = scratch_path(spark, "csv")
    part = load(spark, folder, "part").select("p_partkey", note, "p_retailprice")
    csv_files.write_csv(part, path)
    schema = flat_schema("p_partkey long, note string, p_retailprice double")
    return csv_files.by_name(csv_files.scan_csv(spark, path), schema)


@query(
    "csv_split_scan",
    """
    SELECT doc_id, text || chr(10) || '"' || lang || '", ' || source AS note, md5(text) AS digest FROM documents
    """,
)
def csv_split_scan(spark, folder):
    """Multi-line fields of any length, read block by block."""
    note = F.concat("text", F.lit('\n"'), "lang", F.lit('", '), "source").alias("note")
    path = scratch_path(spark, "csv")
    csv_files.write_csv(load(spark, folder, "documents").select("doc_id", note, F.md5("text").alias("digest")), path)
    return csv_files.by_name(scan_csv_split(spark, path), flat_schema("doc_id long, note string, digest string"))


@query(
    "csv_gzip_scan",
    """
    SELECT l_orderkey, l_partkey, l_linenumber, l_quantity,
           strftime(l_shipdate, '%Y-%m-%d') AS shipped
    FROM lineitem
    """,
)
def csv_gzip_scan(spark, folder):
    path = scratch_path(spark, "gzip")
    shipped = F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped")
    lines = load(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", shipped
    )
    csv_files.write_csv(lines, path, compression="gzip")
    schema = flat_schema(
        "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, shipped string"
    )
    typed = csv_files.by_name(csv_files.scan_csv(spark, path), schema)
    return typed.repartition(F.col("l_orderkey"))


@query(
    "schema_by_name",
    """
    SELECT s_suppkey, s_name, CAST(NULL AS INTEGER) AS s_nationkey,
           CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal
    FROM supplier
    """,
)
def schema_by_name(spark, folder):
    path = scratch_path(spark, "by-name")
    balance = F.when(F.col("s_acctbal") < 0, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    shuffled = load(spark, folder, "supplier").select(
        balance.alias("s_acctbal"), F.lit("x").alias("extra"), "s_name", "s_suppkey"
    )
    csv_files.write_csv(shuffled, path)
    schema = flat_schema(
        "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"
    )
    return csv_files.by_name(csv_files.scan_csv(spark, path), schema)


@query(
    "ingest_stamp",
    "SELECT c_custkey, 'rome' AS city, true AS stamped FROM customer",
)
def ingest_stamp(spark, folder):
    rows = csv_files.ingest_stamp(load(spark, folder, "customer"), "rome")
    stamped = (F.col("ingestion_ts") <= F.current_timestamp()).alias("stamped")
    return rows.select("c_custkey", "city", stamped)


@query(
    "table_sink_overwrite",
    """
    SELECT c_custkey, c_mktsegment, c_acctbal, 'rome' AS city
    FROM customer WHERE c_acctbal BETWEEN 10 AND 5000
    """,
)
def table_sink_overwrite(spark, folder):
    customer = load(spark, folder, "customer").withColumn("city", F.lit("rome"))
    name, path = f"customers_{uuid4().hex}", scratch_path(spark, "table")
    rows = customer.select("c_custkey", "c_mktsegment", "c_acctbal", "city")
    tables.overwrite_table(rows, name, ["city"], path)
    silver = rows.withColumn("c_acctbal", range_to_null(F.col("c_acctbal"))).dropna()
    return tables.overwrite_table(silver, name, ["city"], path)


@query(
    "table_scan",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
)
def table_scan(spark, folder):
    views.register_view(load(spark, folder, "orders"), "scanned_orders")
    return spark.table("scanned_orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("required_columns", "SELECT doc_id, lang FROM documents")
def required_columns(spark, folder):
    return tables.require_columns(load(spark, folder, "documents"), "text").select("doc_id", "lang")


def chunk_versions(spark, folder):
    """Two versions of the documents: some leave, some arrive, some change."""
    docs = load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id", "left")
    changed = F.when(
        (F.col("quality") == 1) & (F.col("lang") == "en"), F.lower("text")
    ).otherwise(F.col("text"))
    old = docs.filter(F.coalesce("quality", F.lit(1)) != 0)
    new = docs.filter(F.coalesce("toxic", F.lit(0)) != 1).withColumn("text", changed)
    return [
        df.select(F.col("doc_id").cast("string").alias("chunk_id"), "lang", "text")
        for df in (old, new)
    ]


CHANGES_SQL = """
    WITH docs AS (SELECT doc_id::VARCHAR AS chunk_id, lang, text, quality, toxic
                  FROM documents LEFT JOIN labels USING (doc_id)),
    old AS (SELECT chunk_id, lang, text FROM docs WHERE coalesce(quality, 1) <> 0),
    new AS (SELECT chunk_id, lang,
                   CASE WHEN quality = 1 AND lang = 'en' THEN lower(text) ELSE text END AS text
            FROM docs WHERE coalesce(toxic, 0) <> 1)
    SELECT chunk_id, lang, length(text) AS chars, md5(text) AS digest, 'insert' AS _change_type
    FROM new WHERE chunk_id NOT IN (SELECT chunk_id FROM old)
    UNION ALL
    SELECT chunk_id, lang, length(text), md5(text), 'delete'
    FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new)
    UNION ALL
    SELECT n.chunk_id, n.lang, length(n.text), md5(n.text), 'update'
    FROM new n JOIN old o USING (chunk_id) WHERE n.text <> o.text
"""


def _changes_view(changes):
    return changes.select(
        "chunk_id",
        "lang",
        F.length("text").cast("bigint").alias("chars"),
        F.md5("text").alias("digest"),
        "_change_type",
    )


@query("gold_sink_cdf", CHANGES_SQL)
def gold_sink_cdf(spark, folder):
    old, new = chunk_versions(spark, folder)
    root = scratch_path(spark, "gold")
    chunk_ops.publish_version(old, root, 1)
    return _changes_view(chunk_ops.publish_version(new, root, 2, previous=1))


@query("snapshot_diff", CHANGES_SQL)
def snapshot_diff(spark, folder):
    return _changes_view(chunk_ops.snapshot_diff(*chunk_versions(spark, folder)))


@query("bucket_diff", CHANGES_SQL)
def bucket_diff(spark, folder):
    """The same changes out of stored versions, by way of bucket digests."""
    old, new = chunk_versions(spark, folder)
    table = VersionedTable(spark, scratch_path(spark, "versions"), new.schema, buckets=32)
    table.publish(old, 1)
    return _changes_view(table.publish(new, 2, previous=1))


def listings(spark, folder):
    """Customers as listings of one city; the nation name is the place."""
    nation = load(spark, folder, "nation")
    customer = load(spark, folder, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.lit("rome").alias("city"),
        F.lower("n_name").alias("neighbourhood"),
        F.col("n_name").alias("neighbourhood_display"),
        (F.col("c_custkey") / 1000).alias("latitude"),
        (F.col("c_custkey") / 2000).alias("longitude"),
        F.col("c_mktsegment").alias("room_type"),
        F.col("c_acctbal").alias("price"),
    )


def places(spark, folder):
    """Nations of the regions whose name starts with A, as official places."""
    nation, region = load(spark, folder, "nation"), load(spark, folder, "region")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return named.filter(F.col("r_name").startswith("A")).select(
        F.lit("rome").alias("city"),
        F.lower("n_name").alias("neighbourhood"),
        F.col("r_name").alias("neighbourhood_group"),
        F.col("n_name").alias("neighbourhood_display"),
    )


ENRICHED_SQL = """
    SELECT c_custkey AS id, c_name AS name, lower(n_name) AS neighbourhood, c_mktsegment AS room_type,
           c_acctbal AS price,
           CASE WHEN r_name LIKE 'A%' THEN r_name END AS official_neighbourhood_group,
           CASE WHEN r_name LIKE 'A%' THEN n_name END AS official_neighbourhood_display
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
ENRICHED = [
    "id", "name", "neighbourhood", "room_type", "price", "official_neighbourhood_group",
    "official_neighbourhood_display",
]


@query("enriched_view", ENRICHED_SQL)
def enriched_view(spark, folder):
    enriched = views.enriched_listings(listings(spark, folder), places(spark, folder))
    return views.register_view(enriched).select(*ENRICHED)


@query(
    "describe_table",
    """
    SELECT column_name AS col_name,
           CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
                WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS data_type
    FROM (DESCRIBE customer)
    """,
)
def describe_table(spark, folder):
    views.register_view(load(spark, folder, "customer"), "described_customer")
    return tables.describe_columns(spark, "described_customer")


SHAPE_SQL = """
    SELECT p_type, count(*) AS n, round(avg(p_retailprice), 2) AS avg_price,
           max(p_retailprice) AS max_price, min(p_retailprice) AS min_price
    FROM {part} WHERE p_name ILIKE '%widget%' GROUP BY p_type ORDER BY p_type
"""


@query("sql_query", SHAPE_SQL.format(part="part"))
def sql_query(spark, folder):
    part = load(spark, folder, "part")
    return tables.sql_query(spark, SHAPE_SQL.format(part="asked_part"), asked_part=part)


@query(
    "query_set_scan",
    """
    SELECT 'q' || vec_id AS query_id, 'label ' || label AS query, unnest([label::VARCHAR, vec_id::VARCHAR])
           AS listing_id
    FROM embeddings WHERE label <> vec_id
    UNION ALL
    SELECT 'q' || vec_id, 'label ' || label, label::VARCHAR FROM embeddings WHERE label = vec_id
    """,
)
def query_set_scan(spark, folder):
    vectors = load(spark, folder, "embeddings")
    ids = F.array(
        F.concat(F.col("label").cast("string"), F.lit(".0")),
        F.concat(F.lit(" "), F.col("vec_id").cast("string")),
    )
    path = scratch_path(spark, "query-set")
    rows = vectors.select(
        F.concat(F.lit("q"), "vec_id").alias("id"),
        F.concat(F.lit("label "), "label").alias("query"),
        ids.alias("relevant_listing_ids"),
    )
    query_sets.write_query_set(rows, path, rows_per_file=500)
    asked, labels = query_sets.read_query_set(spark, path)
    return asked.join(labels, "query_id")


@query(
    "metrics_snapshot_io",
    """
    WITH e AS (SELECT *, json_extract(props, '$.k')::INTEGER AS k FROM events),
    m AS (SELECT *, coalesce(max(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (
              PARTITION BY user_id, k ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hit FROM e),
    p AS (SELECT event_type, value, row_number() OVER (
              PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM e)
    SELECT 'intent' AS kind, event_type AS name, 1::BIGINT AS seq, count(*)::DOUBLE AS value
    FROM m GROUP BY event_type
    UNION ALL
    SELECT 'error', event_type, 1, count(*)::DOUBLE FROM m WHERE event_type = 'error' GROUP BY event_type
    UNION ALL
    SELECT 'cache', CASE hit WHEN 1 THEN 'hit' ELSE 'miss' END, 1, count(*)::DOUBLE FROM m GROUP BY hit
    UNION ALL
    SELECT 'phase', event_type, age, value FROM p WHERE age <= 200
    """,
)
def metrics_snapshot_io(spark, folder):
    from lodgelens.catalog.logs import marked_events

    is_error = F.col("event_type") == "error"
    state = request_log.metric_state(
        marked_events(spark, folder), "event_type", "value", "ts", "event_id", is_error
    )
    path = scratch_path(spark, "metrics")
    metric_state.save_state(state, path)
    return metric_state.load_state(spark, path)


@query(
    "project_rename",
    "SELECT p_partkey AS listing_id, p_brand AS neighbourhood, p_type AS room_type FROM part",
)
def project_rename(spark, folder):
    return load(spark, folder, "part").select(
        F.col("p_partkey").alias("listing_id"),
        F.col("p_brand").alias("neighbourhood"),
        F.col("p_type").alias("room_type"),
    )


@query("filter_compare", "SELECT p_partkey, p_size FROM part WHERE p_size > 10")
def filter_compare(spark, folder):
    return load(spark, folder, "part").filter(F.col("p_size") > 10).select("p_partkey", "p_size")


@query(
    "filter_blank",
    "SELECT doc_id, lang, text FROM documents WHERE lang NOT IN ('fr', 'de') AND length(trim(text)) > 0",
)
def filter_blank(spark, folder):
    blanked = F.when(F.col("lang") == "fr", "   ").when(F.col("lang") != "de", F.col("text"))
    docs = load(spark, folder, "documents").select("doc_id", "lang", blanked.alias("text"))
    return docs.filter(F.length(F.trim("text")) > 0)


@query("filter_in_list", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'es')")
def filter_in_list(spark, folder):
    return load(spark, folder, "documents").filter(F.col("lang").isin("en", "es")).select("doc_id", "lang")


RANGE_SQL = """
    SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 10 AND 5000 THEN c_acctbal END AS price FROM customer
"""


@query("range_to_null", RANGE_SQL)
def range_to_null_query(spark, folder):
    price = range_to_null(F.col("c_acctbal")).alias("price")
    return load(spark, folder, "customer").select("c_custkey", price)


@query("drop_null_keys", f"SELECT * FROM ({RANGE_SQL}) WHERE price IS NOT NULL")
def drop_null_keys(spark, folder):
    return range_to_null_query(spark, folder).dropna(subset=["price"])


@query(
    "ilike_contains",
    "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%widget%'",
)
def ilike_contains(spark, folder):
    part = load(spark, folder, "part")
    return questions.ilike_contains(part, "p_name", "Widget").select("p_partkey", "p_name")


@query(
    "not_null_filter",
    "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
)
def not_null_filter(spark, folder):
    docs = load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id", "left")
    return docs.filter(F.col("quality").isNotNull()).select("doc_id", "quality")


@query(
    "metadata_filter",
    """
    SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    WHERE (o_orderstatus = 'F') OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')
       OR (o_orderstatus = 'P' AND lower(n_name) = 'nation_' || (o_orderkey % 25))
    """,
)
def metadata_filter(spark, folder):
    """Orders as requests about their customer; each request filters by its own columns.

    F asks for the listing, P for a place (mixed case, blanks), urgent O for nothing.
    """
    status, asked = F.col("o_orderstatus"), F.col("o_custkey")
    place = F.concat(F.lit("  Nation_"), (F.col("o_orderkey") % 25).cast("string"), F.lit(" "))
    requests = load(spark, folder, "orders").select(
        "o_orderkey",
        asked.alias("id"),
        F.when(status == "F", asked).alias("want_listing"),
        F.when(status == "P", normalise_name(place)).alias("want_place"),
        ((status == "O") & (F.col("o_orderpriority") == "1-URGENT")).alias("open"),
    )
    pairs = requests.join(listings(spark, folder).select("id", "neighbourhood"), "id")
    none = F.lit(None).cast("string")
    wanted = filter_route(F.col("want_listing"), F.col("want_place"))
    offered = F.array(
        filter_route(none, F.col("neighbourhood")),
        filter_route(F.col("id"), none),
        F.when(F.col("open"), filter_route(none, none)),
    )
    kept = pairs.filter(F.coalesce(F.array_contains(F.array_compact(offered), wanted), F.lit(False)))
    return kept.select("o_orderkey", F.col("id").alias("c_custkey"))


@query("scope_subset", "SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#4'")
def scope_subset(spark, folder):
    part = load(spark, folder, "part").select("p_partkey", "p_brand")
    return questions.scope_subset(part, "p_brand", "Brand#4")
