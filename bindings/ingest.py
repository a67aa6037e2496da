"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query, table
from hirelake.functions.text import text_of
from hirelake.operators.transform import check_records
from hirelake.session import shared_folder
from hirelake.sources.lake import explode_documents, field, field_sql, has_field, read_lake
from hirelake.sources.payload import flatten_payload
from hirelake.sources.sinks import append_raw_lake, export_csv, union_batches

PAGE = 20


def _pages(rows, text_col: str, *keep):
    """At most ``PAGE`` entries per page, whatever the keys look like: pages number the rows of a partition."""
    numbered = rows.withColumn("_page", F.floor(F.monotonically_increasing_id() / PAGE))
    return numbered.groupBy("_page", *keep).agg(F.concat_ws(", ", F.collect_list(text_col)).alias("entries"))


@query("""
SELECT conv_id, turn, role AS title, CASE WHEN turn % 5 = 0 THEN 'N/A' ELSE 'conv ' || conv_id END AS company,
  CASE WHEN turn % 5 = 2 THEN 'N/A' ELSE role END AS location,
  CASE WHEN conv_id % 2 = 0 THEN 'India' ELSE 'United Kingdom' END AS country,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS description,
  CASE turn % 5 WHEN 0 THEN conv_id + 1 || ' - ' || conv_id + 9 WHEN 2 THEN conv_id + 1 || '' ELSE 'N/A' END AS salary,
  'http://x/' || conv_id || '/' || turn AS source_url, '2026-01-02 03:04:05' AS scraped_at
FROM conversations WHERE role <> 'system'""")
def payload_flatten(spark, sf_dir):
    """Conversation turns as API pages: absent members, empty areas, zero and missing salaries; a null company breaks
    the entry."""
    rows = table(spark, sf_dir, "conversations").select("*", F.expr("""
      '{"title": " ' || role || ' ", ' || CASE WHEN role = 'system' THEN '"company": null, ' WHEN turn % 5 = 0 THEN ''
        ELSE '"company": {"display_name": "conv ' || conv_id || '"}, ' END
      || CASE turn % 5 WHEN 2 THEN '"location": {"area": []}, ' ELSE '"location": {"area": ["World", "' || role || '"]}, ' END
      || CASE turn % 5 WHEN 0 THEN '"salary_min": ' || (conv_id + 1) || ', "salary_max": ' || (conv_id + 9) || ', '
        WHEN 2 THEN '"salary_min": ' || (conv_id + 1) || ', ' WHEN 3 THEN '"salary_min": 0, "salary_max": 5, '
        ELSE '"salary_max": 7, ' END
      || '"redirect_url": "http://x/' || conv_id || '/' || turn || '", '
      || substr(to_json(struct(coalesce(text, '') AS description)), 2)""").alias("entry"),
        F.when(F.col("conv_id") % 2 == 0, "in").otherwise("gb").alias("market"))
    payloads = _pages(rows, "entry", "market").select(
        "market", F.concat(F.lit('{"count": 1, "results": ['), "entries", F.lit("]}")).alias("payload"))
    good, _ = flatten_payload(payloads, "payload", "market", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    key = F.split("source_url", "/")
    return good.select(key[3].cast("long").alias("conv_id"), key[4].cast("long").alias("turn"), "title", "company",
                       "location", "country", "description", "salary", "source_url", "scraped_at")


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def json_envelopes(spark, sf_dir):
    """Documents of every shape: bare array and one list under each of the four envelope keys."""
    entries = table(spark, sf_dir, "events").select(F.expr(
        """'{"ID": ' || event_id || ', "type": "' || event_type || '", "props": ' || props || '}'""").alias("entry"))
    documents = _pages(entries, "entry").select(F.lit("page").alias("file"), F.concat(
        F.element_at(F.array(*[F.lit(t) for t in (
            "[", '{"results": [', '{"results": 1, "jobs": [', '{"data": [', '{"jobs": null, "postings": [')]),
            (F.col("_page") % 5 + 1).cast("int")),
        "entries", F.when(F.col("_page") % 5 == 0, "]").otherwise("]}")).alias("value"))
    records = explode_documents(documents)
    return records.select(text_of(field_sql("id")).cast("long").alias("event_id"), text_of(field_sql("type")).alias("event_type"),
                          F.try_variant_get(field("props"), "$.k", "string").alias("k"))


BROKEN = "event_id % 10 = 3"


@query(f"""SELECT CASE WHEN {BROKEN} THEN '' ELSE event_type END AS title, CASE WHEN {BROKEN} THEN '' ELSE 'event ' || event_id END AS description,
  CASE WHEN {BROKEN} THEN 'unreadable record' END AS reason,
  CASE WHEN {BROKEN} THEN '{{"Title": "' || event_type || '", "description": "event ' || event_id || '}}' END AS raw FROM events""")
def broken_lines(spark, sf_dir):
    """JSON Lines in files read as documents, every tenth line cut short: the other lines are records, the broken ones
    are set aside with their text."""
    path = shared_folder(spark, "broken-lines")
    events = table(spark, sf_dir, "events").select(F.expr(
        f"""'{{"Title": "' || event_type || '", "description": "event ' || event_id || if({BROKEN}, '}}', '"}}')""").alias("line"))
    events.write.text(path)
    checked = check_records(read_lake(spark, path, "json"))
    return checked.select("title", "description", "reason", "raw")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf_dir):
    """CSV export and CSV scan; quoted line breaks and quotes survive."""
    path = shared_folder(spark, "csv")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(" Key "), F.concat(F.lit('a "quoted",\n'), "c_name").alias("NAME"), "c_mktsegment")
    export_csv(rows, path)
    records = read_lake(spark, path, "csv")
    return records.select(
        text_of(field_sql("key")).cast("long").alias("c_custkey"),
        F.replace(text_of(field_sql("name")), F.lit('a "quoted",\n'), F.lit("")).alias("c_name"),
        text_of(field_sql("c_mktsegment")).alias("c_mktsegment"))


@query("""SELECT event_id, event_type, value, CASE WHEN value > 10 THEN NULL ELSE 'x' END AS note, true AS has_note
  FROM events""")
def lines_roundtrip(spark, sf_dir):
    """Raw-lake sink and its JSON Lines scan; present-but-null keys stay present."""
    path = shared_folder(spark, "lake")
    rows = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", F.when(F.col("value") > 10, None).otherwise("x").alias("note"))
    append_raw_lake(rows, path, "2026-01-02")
    records = read_lake(spark, path, "lines")
    return records.select(
        text_of(field_sql("event_id")).cast("long").alias("event_id"), text_of(field_sql("event_type")).alias("event_type"),
        field("value").cast("double").alias("value"), field("note").cast("string").alias("note"),
        has_field("note").alias("has_note"))


@query("""SELECT o_orderkey AS id, 'orders' AS origin, o_orderpriority AS note FROM orders
UNION ALL SELECT l_orderkey, 'lineitem', NULL FROM lineitem UNION ALL SELECT event_id, 'events', event_type FROM events""")
def batch_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("orders").alias("origin"), F.col("o_orderpriority").alias("note"))
    lines = table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("origin"), F.col("l_orderkey").alias("id"))
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("note"), F.col("event_id").alias("id"), F.lit("events").alias("origin"))
    return union_batches(orders, lines, events)
