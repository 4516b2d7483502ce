"""Evaluation inputs derived from the driver tables (no live model exists).

Everything here is a deterministic projection of whole tables, written so the same columns can
be defined in SQL: integer arithmetic only, no randomness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Per-million-token prices (input, output) of the priced models, and the default.
# m3 is deliberately absent so the default rate is exercised.
PRICES = [("m0", 1.25, 10.0), ("m1", 0.25, 2.0), ("m2", 0.95, 4.0)]
DEFAULT_PRICE = (1.0, 5.0)

CONFIG_HASH = "f9a15da1"


def run_log(catalog) -> DataFrame:
    """One row per (task, model) answer: four models answer every task.

    task_id = event_id div 4, model = 'm' || event_id % 4, k from the event's JSON props.
    """
    ev = catalog.events.select("event_id", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    task = F.expr("event_id div 4")
    return ev.select(
        task.alias("task_id"),
        F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("model"),
        F.when(task % 3 == 0, "single_hop").when(task % 3 == 1, "multi_hop").otherwise("negative").alias("category"),
        F.when(task % 5 == 0, "dev").when(task % 5 <= 2, "train").alias("split"),
        k.alias("k"),
        (F.lit(1000) + 100 * k).cast("long").alias("input_tokens"),
        (F.lit(20) + k).cast("long").alias("output_tokens"),
        F.floor(F.col("value") * 100).cast("long").alias("latency_ms"),
        (k % 8 != 0).alias("correct"),
        F.when(k % 5 != 0, k % 7 != 0).alias("judge_correct"),
        F.lit(True).alias("called"),
        (k % 20 != 0).alias("has_rows"),
        F.array(F.struct(
            F.when(F.col("event_type") == "view", "fabric_kb_retrieve")
             .when(F.col("event_type") == "click", "mcp_call").otherwise(F.col("event_type")).alias("type"),
            F.concat(F.col("event_type"), F.lit("_tool")).alias("name"))).alias("tool_calls"),
        F.lit(CONFIG_HASH).alias("config_hash"),
        F.col("user_id"),
    )


RUN_LOG_SQL = """
SELECT event_id // 4 AS task_id, 'm' || CAST(event_id % 4 AS VARCHAR) AS model,
       CASE (event_id // 4) % 3 WHEN 0 THEN 'single_hop' WHEN 1 THEN 'multi_hop' ELSE 'negative' END AS category,
       CASE WHEN (event_id // 4) % 5 = 0 THEN 'dev' WHEN (event_id // 4) % 5 <= 2 THEN 'train' END AS split,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(1000 + 100 * CAST(json_extract_string(props, '$.k') AS INTEGER) AS BIGINT) AS input_tokens,
       CAST(20 + CAST(json_extract_string(props, '$.k') AS INTEGER) AS BIGINT) AS output_tokens,
       CAST(floor(value * 100) AS BIGINT) AS latency_ms,
       CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 <> 0 AS correct,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 <> 0
            THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 <> 0 END AS judge_correct,
       TRUE AS called,
       CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 <> 0 AS has_rows,
       CASE event_type WHEN 'view' THEN 'fabric_kb_retrieve' WHEN 'click' THEN 'mcp_call' ELSE event_type END
         AS tool_type,
       event_type || '_tool' AS tool_name,
       'f9a15da1' AS config_hash, user_id
FROM events"""


def prices(spark) -> DataFrame:
    """Price list as a table (tiny, fixed size)."""
    return spark.createDataFrame(PRICES, "model string, input_rate double, output_rate double")


PRICES_SQL = ("(VALUES " + ", ".join(f"('{m}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, i, o in PRICES)
              + ") p(model, input_rate, output_rate)")


def scalar_answers(catalog) -> DataFrame:
    """Per customer: expected = its order count; the answer text states it, off by one when
    custkey % 3 = 0. Customer names hold digits too, which exercises the any-number rule."""
    per = catalog.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    c = catalog.customer.select("c_custkey", "c_name")
    j = c.join(per, c.c_custkey == per.o_custkey, "left").select(
        "c_custkey", "c_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))
    stated = F.col("n_orders") + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)
    text = F.when(F.col("c_custkey") % 7 == 0,
                  F.concat(F.lit("About "), stated.cast("string"), F.lit(".  orders\u00a0for "), F.col("c_name")))\
        .otherwise(F.concat(F.col("c_name"), F.lit(" placed "), stated.cast("string"), F.lit(" orders")))
    return j.select(F.col("c_custkey").alias("task_id"), F.col("n_orders").cast("double").alias("expected"),
                    text.alias("answer"))


SCALAR_ANSWERS_SQL = """
SELECT c.c_custkey AS task_id, CAST(COALESCE(o.n_orders, 0) AS DOUBLE) AS expected,
       CASE WHEN c.c_custkey % 7 = 0
            THEN 'About ' || CAST(COALESCE(o.n_orders, 0) + CASE WHEN c.c_custkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR)
                 || '.  orders' || chr(160) || 'for ' || c.c_name
            ELSE c.c_name || ' placed ' ||
                 CAST(COALESCE(o.n_orders, 0) + CASE WHEN c.c_custkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) || ' orders'
       END AS answer
FROM customer c LEFT JOIN (SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey) o
  ON c.c_custkey = o.o_custkey"""


def set_answers(catalog) -> DataFrame:
    """Per nation: expected = its customers' distinct segments (at most a handful per nation);
    the answer lists them, omitting the first for every fourth nation."""
    segs = (catalog.customer.select("c_nationkey", "c_mktsegment").distinct()
            .groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_mktsegment")).alias("expected_values")))
    shown = F.when(F.col("c_nationkey") % 4 == 0, F.slice("expected_values", F.lit(2), F.size("expected_values"))).otherwise(F.col("expected_values"))
    return segs.select(F.col("c_nationkey").alias("task_id"), "expected_values",
                       F.concat(F.lit("Segments: "), F.array_join(shown, ", ")).alias("answer"))


def refusal_answers(catalog) -> DataFrame:
    """Assistant turns of the conversations as answers to refusal questions; a verdict exists for
    every fifth turn (the judge column), the rest fall back to the keyword heuristic."""
    conv = catalog.conversations.where(F.col("role") == "assistant")
    return conv.select("conv_id", "turn", F.col("text").alias("answer"),
                       F.when(F.col("turn") % 5 == 0, F.col("turn") % 10 == 0).alias("verdict"))


def references(catalog) -> DataFrame:
    """Evidence blocks: each order is one reference of its customer's question, numbered by order key.
    ``raw`` is CSV text (header + one row); the notes cell holds a quoted comma."""
    o = catalog.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    header = "o_orderkey,o_orderstatus,o_totalprice,o_orderpriority,notes"
    row = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus",
                      F.format_string("%.2f", "o_totalprice"), "o_orderpriority",
                      F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(", status "), F.col("o_orderstatus"),
                               F.lit('"')))
    return o.select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("ref_no"),
                    F.concat(F.lit(header + "\n"), row).alias("raw"))


REFERENCES_SQL = """
SELECT o_custkey AS question_id, o_orderkey AS ref_no,
       'o_orderkey,o_orderstatus,o_totalprice,o_orderpriority,notes' || chr(10) ||
       CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus || ',' || printf('%.2f', o_totalprice) || ',' ||
       o_orderpriority || ',"' || o_orderpriority || ', status ' || o_orderstatus || '"' AS raw
FROM orders"""


def candidates(catalog) -> DataFrame:
    """Tuning log: every user is one run, its events ordered by (ts, event_id) are the steps;
    the first step is the seed. Train/DEV summaries are integer functions of k and value."""
    ev = catalog.events.select("event_id", "ts", "user_id", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("user_id").alias("run_id"), F.col("ts").alias("step_ts"), F.col("event_id").alias("cid"),
        k.cast("double").alias("train_acc"), F.floor(F.col("value") * 100).cast("long").alias("train_tokens"),
        (k % 4).alias("train_neg"),
        ((7 * k) % 101).cast("double").alias("dev_acc"), (F.lit(1000) + (13 * k) % 997).cast("long").alias("dev_tokens"),
        ((k + 1) % 4).alias("dev_neg"))


CANDIDATES_SQL = """
SELECT user_id AS run_id, ts AS step_ts, event_id AS cid,
       CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS train_acc,
       CAST(floor(value * 100) AS BIGINT) AS train_tokens,
       CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS train_neg,
       CAST((7 * CAST(json_extract_string(props, '$.k') AS INTEGER)) % 101 AS DOUBLE) AS dev_acc,
       CAST(1000 + (13 * CAST(json_extract_string(props, '$.k') AS INTEGER)) % 997 AS BIGINT) AS dev_tokens,
       (CAST(json_extract_string(props, '$.k') AS INTEGER) + 1) % 4 AS dev_neg
FROM events"""
