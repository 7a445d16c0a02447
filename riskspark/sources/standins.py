"""Account, usage, ticket, survey and note tables derived from a TPC-H-like schema.

One SQL text serves Spark and a second SQL engine; only day differences and regular
expression classes differ between dialects.
"""

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from riskspark.sources.tables import Tables

REF = date(2001, 8, 1)

_SEGMENT = "concat(substr(c_mktsegment, 1, 1), lower(substr(c_mktsegment, 2)))"
V_ACCOUNTS = f"""
SELECT c_custkey AS account_id,
       concat('Firm', lpad(CAST(c_custkey AS STRING), 6, '0'), ' ', {_SEGMENT}) AS account_name,
       CAST(floor(greatest(c_acctbal, 0) * 100) AS BIGINT) AS arr,
       DATE '2001-08-01' + CAST((c_custkey * 37) % 365 - 30 AS INT) AS contract_end_date,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Enterprise' WHEN 'MACHINERY' THEN 'Scale'
            WHEN 'AUTOMOBILE' THEN 'Growth' ELSE 'Starter' END AS plan_tier,
       c_mktsegment AS industry, n_name AS csm_name, r_name AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

V_USAGE = """
SELECT account_id, CAST(concat('2001-0', CAST(bucket + 2 AS STRING), '-01') AS DATE) AS month,
       api_calls, content_entries_created, active_users, workflows_triggered,
       CASE k % 7 WHEN 0 THEN 'v4.3.0' WHEN 1 THEN 'v4.1.0' WHEN 2 THEN 'v4.2.3' WHEN 3 THEN 'v4.0.0'
            WHEN 4 THEN 'v3.2.0' WHEN 5 THEN 'v3.1.2' ELSE 'v3.4.1' END AS sdk_version
FROM (
  SELECT account_id, bucket, count(*) AS api_calls,
         count(CASE WHEN event_type = 'purchase' THEN 1 END) AS content_entries_created,
         count(DISTINCT event_type) AS active_users,
         count(CASE WHEN event_type = 'click' THEN 1 END) AS workflows_triggered,
         max_by(k, event_id) AS k
  FROM (SELECT user_id AS account_id, event_id, event_type,
               CAST(least(floor((day(ts) - 1) / 5e0), 5) AS INT) AS bucket,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
        FROM events) e
  GROUP BY account_id, bucket) u
"""

V_TICKETS = """
SELECT o_orderkey AS ticket_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS created_date,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'P1' WHEN '2-HIGH' THEN 'P2' WHEN '3-MEDIUM' THEN 'P3'
            WHEN '5-LOW' THEN 'P4' ELSE 'P?' END AS priority,
       CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Escalated' ELSE 'Resolved' END AS status,
       o_orderpriority AS subject,
       CASE WHEN o_orderstatus = 'F' THEN 24e0 * {days} END AS resolution_time_hours
FROM orders LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS shipped FROM lineitem
                       GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
"""

V_NPS = """
SELECT doc_id AS account_id,
       CASE WHEN doc_id % 17 <> 0 THEN CAST((doc_id * 7) % 11 AS DOUBLE) END AS score,
       coalesce(text, '') AS verbatim_comment
FROM documents
"""

# note headers in six styles, one in six of the last without any
V_NOTE_TEXTS = f"""
SELECT conv_id * 1000 + turn AS note_pos, conv_id,
       concat(CASE
         WHEN conv_id % 36 = 3 THEN concat('march 25 -- Firm', lpad(CAST(conv_id AS STRING), 5, '0'), ' ',
              replace(coalesce(segment, ''), 'i', 'l'), '{chr(10)}sync{chr(10)}')
         WHEN conv_id % 6 = 0 THEN concat('2001-03-20 | Firm', lpad(CAST(conv_id AS STRING), 6, '0'), ' ',
              coalesce(segment, ''), ' | desk', '{chr(10)}')
         WHEN conv_id % 6 = 1 THEN concat('3/15 acct ', lpad(CAST(conv_id AS STRING), 4, '0'), ' - call{chr(10)}')
         WHEN conv_id % 6 = 2 THEN concat('12/05 - firm', lpad(CAST(conv_id AS STRING), 6, '0'), ' call{chr(10)}')
         WHEN conv_id % 6 = 3 THEN 'march 25 -- evaluating alternatives, no show{chr(10)}'
         WHEN conv_id % 6 = 4 THEN ''
         ELSE concat('(#', lpad(CAST(conv_id AS STRING), 4, '0'), ') Apr 1, great QBR, budget approved{chr(10)}')
       END, text) AS raw_text
FROM conversations LEFT JOIN (SELECT c_custkey, {_SEGMENT} AS segment FROM customer) c ON c_custkey = conv_id
"""
V_NOTES = "SELECT note_pos, conv_id AS account_id, raw_text FROM v_note_texts"

VIEWS = {"v_accounts": V_ACCOUNTS, "v_usage": V_USAGE, "v_tickets": V_TICKETS, "v_nps": V_NPS,
         "v_note_texts": V_NOTE_TEXTS, "v_notes": V_NOTES}
# declared, so that building a query reads no file footers
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}

SPARK_DIALECT = {"days": "datediff(shipped, CAST(o_orderdate AS DATE))"}
DUCKDB_DIALECT = {"days": "date_diff('day', CAST(o_orderdate AS DATE), shipped)"}


def view_sql(name: str, dialect: dict[str, str]) -> str:
    text = VIEWS[name]
    for key, value in dialect.items():
        text = text.replace("{" + key + "}", value)
    return text


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(RAW[table]).parquet(f"{sf_dir}/{table}.parquet")


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table; inputs are passed as data frames, so no session view is left behind."""
    text = view_sql(name, SPARK_DIALECT)
    for view in VIEWS:
        text = re.sub(rf"\bFROM {view}\b", f"FROM ({view_sql(view, SPARK_DIALECT)}) {view}", text)
    used = [t for t in RAW if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
    for table in used:
        text = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}} {table}", text)
    return spark.sql(text, **{t: raw(spark, sf_dir, t) for t in used})


def standin_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The bundle; usage has one row per account and bucket, surveys one per account."""
    get = lambda name: standin(spark, sf_dir, name)
    return Tables(accounts=get("v_accounts"), usage=get("v_usage"), tickets=get("v_tickets"),
                  nps=get("v_nps"), notes=get("v_notes"), reference_date=REF,
                  unique_months=True, unique_surveys=True)
