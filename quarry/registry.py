"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with the equivalent DuckDB SQL.

Every query reads whole driver tables (or data Spark derives from them). Column names are
aliased identically in the DataFrame plan and in the SQL.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import graph as G
from quarry.plans import questions as Q
from quarry.plans import truth as TR
from quarry.plans.bindings import driver_ontology, entity_view
from quarry.sources.tables import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _bigint_sums(sql: str) -> str:
    """DuckDB sums integers into HUGEINT; Spark into BIGINT. Wrap integer sums so both engines
    report BIGINT (sums of cost, which are doubles, are left alone)."""
    out, i = [], 0
    while True:
        j = sql.find("SUM(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + 3
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        expr = sql[j:k + 1]
        inner = _bigint_sums(expr[4:-1])
        expr = f"SUM({inner})"
        out.append(sql[i:j])
        out.append(expr if "cost" in inner or "value" in inner else f"CAST({expr} AS BIGINT)")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _bigint_sums(sql.strip())
        return fn
    return deco


def _sem(spark: SparkSession, sf_dir: str) -> Q.Semantic:
    return Q.Semantic(Catalog(spark, sf_dir), driver_ontology())


# --- B: semantic layer and graph -------------------------------------------------------------------

register("entity_view", """
SELECT p_partkey AS part_id, p_name AS part_name, p_brand AS brand, p_type AS part_type,
       p_size AS size, p_retailprice AS retail_price FROM part
""")(lambda spark, d: entity_view(Catalog(spark, d), driver_ontology().entity("Part")))

LINE_KEY_SQL = ("concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
                "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR))")

def _props_sql(props: dict[str, str]) -> str:
    """JSON object of texts: property name -> SQL of its text."""
    quoted = "'\"' || replace(replace({v}, '\\', '\\\\'), '\"', '\\\"') || '\"'"
    return "'{' || concat_ws(',', " + ", ".join(
        f"""'"{name}":' || {quoted.format(v=f'CAST({v} AS VARCHAR)')}""" for name, v in props.items()) + ") || '}'"


register("graph_nodes", f"""
SELECT 'Customer' AS node_type, CAST(c_custkey AS VARCHAR) AS node_key, c_name AS node_label, 5 AS n_props,
       {_props_sql({"customer_id": "c_custkey", "customer_name": "c_name", "nation_id": "c_nationkey",
                    "account_balance": "c_acctbal", "segment": "c_mktsegment"})} AS props FROM customer
UNION ALL SELECT 'Supplier', CAST(s_suppkey AS VARCHAR), s_name, 4,
       {_props_sql({"supplier_id": "s_suppkey", "supplier_name": "s_name", "nation_id": "s_nationkey",
                    "account_balance": "s_acctbal"})} FROM supplier
UNION ALL SELECT 'Nation', CAST(n_nationkey AS VARCHAR), n_name, 3,
       {_props_sql({"nation_id": "n_nationkey", "nation_name": "n_name", "region_id": "n_regionkey"})} FROM nation
UNION ALL SELECT 'Part', CAST(p_partkey AS VARCHAR), p_name, 6,
       {_props_sql({"part_id": "p_partkey", "part_name": "p_name", "brand": "p_brand", "part_type": "p_type",
                    "size": "p_size", "retail_price": "p_retailprice"})} FROM part
UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), 6,
       {_props_sql({"order_id": "o_orderkey", "customer_id": "o_custkey", "status": "o_orderstatus",
                    "total_price": "o_totalprice", "order_date": "o_orderdate", "priority": "o_orderpriority"})} FROM orders
UNION ALL SELECT 'LineItem', {LINE_KEY_SQL}, {LINE_KEY_SQL}, 10,
       {_props_sql({"order_id": "l_orderkey", "line_number": "l_linenumber", "part_id": "l_partkey",
                    "supplier_id": "l_suppkey", "ship_date": "CAST(l_shipdate AS DATE)", "quantity": "l_quantity",
                    "extended_price": "l_extendedprice", "discount": "l_discount", "return_flag": "l_returnflag",
                    "line_status": "l_linestatus"})} FROM lineitem
""")(lambda spark, d: G.graph_nodes(Catalog(spark, d), driver_ontology()))

register("graph_edges", f"""
SELECT 'placedOrder' AS rel_type, CAST(o_custkey AS VARCHAR) AS src_key, CAST(o_orderkey AS VARCHAR) AS dst_key
  FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL
UNION ALL SELECT 'shippedLine', CAST(l_suppkey AS VARCHAR), {LINE_KEY_SQL} FROM lineitem
  WHERE l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL
    AND l_shipdate IS NOT NULL
UNION ALL SELECT 'ofPart', {LINE_KEY_SQL}, CAST(l_partkey AS VARCHAR) FROM lineitem
  WHERE l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL
    AND l_shipdate IS NOT NULL
UNION ALL SELECT 'customerNation', CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR) FROM customer
  WHERE c_custkey IS NOT NULL AND c_nationkey IS NOT NULL
UNION ALL SELECT 'supplierNation', CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR) FROM supplier
  WHERE s_suppkey IS NOT NULL AND s_nationkey IS NOT NULL
""")(lambda spark, d: G.graph_edges(Catalog(spark, d), driver_ontology()))


@register("traverse_path", """
SELECT s.s_name AS supplier_name, p.p_type AS part_type, COUNT(*) AS n_lines
FROM supplier s JOIN lineitem l ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY s.s_name, p.p_type
""")
def _traverse_path(spark, d):
    sem = _sem(spark, d)
    t = G.traverse(sem.catalog, sem.onto, ["Supplier", "shippedLine", "LineItem", "ofPart", "Part"],
                   select={"Supplier": ["supplier_name"], "Part": ["part_type"]})
    return (t.groupBy(F.col("supplier_supplier_name").alias("supplier_name"), F.col("part_part_type").alias("part_type"))
            .agg(F.count(F.lit(1)).alias("n_lines")))


@register("key_violations", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
""")
def _key_violations(spark, d):
    return G.key_violations(Catalog(spark, d).lineitem, ["l_orderkey", "l_linenumber"])


def _key_sql(entity: str, table: str, cols: list[str]) -> str:
    key = ", ".join(cols)
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in cols)
    none = " OR ".join(f"{c} IS NULL" for c in cols)
    return (f"SELECT '{entity}' AS node_type, concat_ws(':', {text}) AS key_text, COUNT(*) AS n FROM {table} "
            f"GROUP BY {key} HAVING COUNT(*) > 1 OR {none}")


# besides the declared keys (which hold on the driver tables), a part identified by brand and size alone
register("entity_key_violations", " UNION ALL ".join([
    _key_sql("Customer", "customer", ["c_custkey"]), _key_sql("Supplier", "supplier", ["s_suppkey"]),
    _key_sql("Nation", "nation", ["n_nationkey"]), _key_sql("Part", "part", ["p_brand", "p_size"]),
    _key_sql("Order", "orders", ["o_orderkey"]),
    _key_sql("LineItem", "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_shipdate AS DATE)"])]))(
    lambda spark, d: G.entity_key_violations(Catalog(spark, d), _with_part_key(driver_ontology())))


def _with_part_key(onto):
    from dataclasses import replace
    return replace(onto, entities=onto.entities | {"Part": replace(onto.entity("Part"), key=("brand", "size"))})


_ENDS = {"placedOrder": ("orders", "o_custkey", "Customer", "o_orderkey", "Order"),
         "shippedLine": ("lineitem", "l_suppkey", "Supplier", LINE_KEY_SQL, "LineItem"),
         "ofPart": ("lineitem", LINE_KEY_SQL, "LineItem", "l_partkey", "Part"),
         "customerNation": ("customer", "c_custkey", "Customer", "c_nationkey", "Nation"),
         "supplierNation": ("supplier", "s_suppkey", "Supplier", "s_nationkey", "Nation")}
_LIVE = {"Customer": "SELECT c_custkey FROM customer WHERE c_acctbal >= 0", "Supplier": "SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0",
         "Nation": "SELECT n_nationkey FROM nation", "Part": "SELECT p_partkey FROM part", "Order": "SELECT o_orderkey FROM orders",
         "LineItem": f"SELECT {LINE_KEY_SQL} FROM lineitem"}


def _ends_sql() -> str:
    parts = []
    for rel, (t, src, a, dst, b) in _ENDS.items():
        for end, key, entity in (("src_key", src, a), ("dst_key", dst, b)):
            parts.append(f"SELECT '{rel}' AS rel_type, '{end}' AS edge_end, CAST({key} AS VARCHAR) AS missing_key, COUNT(*) AS n_edges "
                         f"FROM {t} WHERE {key} NOT IN ({_LIVE[entity]}) GROUP BY {key}")
    return " UNION ALL ".join(parts)


def _live(onto):
    from dataclasses import replace
    live = {n: replace(onto.entity(n), where="account_balance >= 0") for n in ("Customer", "Supplier")}
    return replace(onto, entities=onto.entities | live)


# both ends of all relationships, with the customers and suppliers in debt left out of the nodes
register("dangling_ends", _ends_sql())(lambda spark, d: G.dangling_ends(Catalog(spark, d), _live(driver_ontology())))


# --- C: question templates ---------------------------------------------------------------------

Q_SQL: dict[str, tuple[str, str]] = {
    # id -> (kind, SQL producing column ``answer``); kind: num | text | set
    "S01": ("num", "SELECT COUNT(*) AS answer FROM orders WHERE o_orderstatus = 'F'"),
    "S02": ("num", "SELECT COUNT(DISTINCT c_mktsegment) AS answer FROM customer"),
    "S03": ("set", "SELECT DISTINCT o_orderpriority AS answer FROM orders"),
    "S04": ("num", "SELECT COUNT(*) AS answer FROM part WHERE p_type = 'PROMO'"),
    "S05": ("text", "SELECT p_type AS answer FROM part GROUP BY p_type ORDER BY COUNT(*) DESC, p_type LIMIT 1"),
    "S06": ("num", "SELECT ROUND(AVG(l_extendedprice), 2) AS answer FROM lineitem"),
    "S07": ("num", "SELECT ROUND(MAX(l_extendedprice), 2) AS answer FROM lineitem"),
    "S08": ("num", "SELECT COUNT(DISTINCT l_returnflag) AS answer FROM lineitem"),
    "M01": ("set", "SELECT c.c_name AS answer FROM (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, "
                   "o_orderkey LIMIT 5) o JOIN customer c ON o.o_custkey = c.c_custkey"),
    "M02": ("set", "SELECT DISTINCT s.s_name AS answer FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey "
                   "JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_type = 'PROMO' AND p.p_size = 1"),
    "M03": ("set", "SELECT DISTINCT o.o_orderpriority AS answer FROM orders o JOIN customer c "
                   "ON o.o_custkey = c.c_custkey WHERE c.c_name = 'Customer#000000007'"),
    "M04": ("set", "SELECT DISTINCT s.s_name AS answer FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey "
                   "JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_returnflag = 'R' AND p.p_brand = 'Brand#2' "
                   "AND p.p_size <= 2"),
    "M05": ("num", "SELECT COUNT(*) AS answer FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey "
                   "WHERE s.s_name = 'Supplier#000000003'"),
    "M06": ("set", "SELECT DISTINCT l.l_partkey AS answer FROM lineitem l JOIN supplier s "
                   "ON l.l_suppkey = s.s_suppkey WHERE s.s_nationkey = 3"),
    "M07": ("set", "SELECT DISTINCT o.o_orderpriority AS answer FROM orders o JOIN customer c "
                   "ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey "
                   "WHERE n.n_name = 'NATION_3'"),
    "M08": ("num", "SELECT ROUND(AVG(l.l_extendedprice), 2) AS answer FROM lineitem l JOIN part p "
                   "ON l.l_partkey = p.p_partkey WHERE p.p_name = 'small ring'"),
    "M09": ("text", "SELECT p.p_name AS answer FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey "
                    "GROUP BY p.p_name ORDER BY COUNT(*) DESC, p.p_name LIMIT 1"),
    "M10": ("set", "SELECT DISTINCT c.c_name AS answer FROM customer c WHERE c.c_custkey IN "
                   "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c.c_custkey IN "
                   "(SELECT o_custkey FROM orders WHERE o_totalprice > 490000)"),
    "T-S01": ("num", "SELECT COUNT(*) AS answer FROM supplier WHERE s_nationkey = 8"),
    "T-S02": ("num", "SELECT COUNT(*) AS answer FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "T-S03": ("set", "SELECT DISTINCT p_type AS answer FROM part"),
    "T-S04": ("num", "SELECT COUNT(*) AS answer FROM part WHERE p_brand = 'Brand#7'"),
    "T-S05": ("num", "SELECT ROUND(AVG(l_discount), 2) AS answer FROM lineitem"),
    "T-S06": ("num", "SELECT ROUND(MAX(o_totalprice), 2) AS answer FROM orders"),
    "T-M01": ("set", "SELECT s.s_name AS answer FROM (SELECT l_suppkey FROM lineitem ORDER BY l_extendedprice DESC, "
                     "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 5) l "
                     "JOIN supplier s ON l.l_suppkey = s.s_suppkey"),
    "T-M02": ("set", "SELECT DISTINCT s.s_name AS answer FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey "
                     "JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_brand = 'Brand#5' AND p.p_size <= 3"),
    "T-M03": ("set", "SELECT DISTINCT o.o_orderstatus AS answer FROM orders o JOIN customer c "
                     "ON o.o_custkey = c.c_custkey WHERE c.c_name = 'Customer#000000010'"),
    "T-M04": ("set", "SELECT DISTINCT l.l_partkey AS answer FROM lineitem l JOIN supplier s "
                     "ON l.l_suppkey = s.s_suppkey WHERE s.s_nationkey = 8"),
    "T-M05": ("num", "SELECT COUNT(*) AS answer FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
                     "WHERE c.c_name = 'Customer#000000010'"),
    "T-M06": ("set", "SELECT DISTINCT o.o_orderpriority AS answer FROM orders o JOIN customer c "
                     "ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey "
                     "WHERE n.n_name = 'NATION_5'"),
    "T-M07": ("num", "SELECT ROUND(AVG(l.l_extendedprice), 2) AS answer FROM lineitem l JOIN part p "
                     "ON l.l_partkey = p.p_partkey WHERE p.p_name = 'red widget'"),
    "T-M08": ("set", "SELECT DISTINCT s.s_name AS answer FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey "
                     "JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_type = 'SMALL' AND p.p_size = 1"),
}

QUESTION_QUERIES = {
    "q_count_filtered": "S01", "q_count_distinct": "S02", "q_distinct_values": "S03",
    "q_count_filtered_dim": "S04", "q_top1_group": "S05", "q_avg_metric": "S06", "q_max_metric": "S07",
    "q_count_distinct_fact": "S08", "q_topk_by_metric": "M01", "q_path3_distinct": "M02",
    "q_path2_named": "M03", "q_path3_flag": "M04", "q_path2_count": "M05", "q_path3_reverse": "M06",
    "q_path2_group_filter": "M07", "q_path2_avg": "M08", "q_top1_group_join": "M09",
    "q_semi_intersection": "M10",
}


def _question_query(qid: str):
    def run(spark, d):
        return Q.QUESTION_BY_ID[qid].build(_sem(spark, d))
    return run


for _name, _qid in QUESTION_QUERIES.items():
    register(_name, Q_SQL[_qid][1])(_question_query(_qid))


def _probe_sql() -> str:
    table_of = {"Supplier": ("supplier", {"supplier_name": "s_name"}),
                "Customer": ("customer", {"customer_name": "c_name", "segment": "c_mktsegment"}),
                "Part": ("part", {"part_name": "p_name", "brand": "p_brand", "part_type": "p_type"}),
                "Nation": ("nation", {"nation_name": "n_name"}),
                "Order": ("orders", {"priority": "o_orderpriority"})}
    rows = ", ".join(f"('{i}', '{v}')" for i, _, _, v in Q.NEGATIVE_PROBES)
    counts = " UNION ALL ".join(
        f"SELECT '{i}' AS id, COUNT(*) AS n FROM {table_of[e][0]} WHERE {table_of[e][1][p]} = '{v}'"
        for i, e, p, v in Q.NEGATIVE_PROBES)
    return (f"SELECT q.id, q.probe_value, CAST(COALESCE(c.n, 0) AS BIGINT) AS n_matches, "
            f"CASE WHEN COALESCE(c.n, 0) = 0 THEN 'refusal' ELSE 'scalar' END AS answer_type "
            f"FROM (VALUES {rows}) q(id, probe_value) LEFT JOIN ({counts}) c ON q.id = c.id")


register("q_unanswerable", _probe_sql())(lambda spark, d: Q.unanswerable(_sem(spark, d)))

register("q_unknown_entity", """
SELECT q.id, q.supplier_name, c.n_lines, CASE WHEN c.n_lines IS NULL THEN 'no rows' ELSE 'rows' END AS status
FROM (VALUES ('N06', 'Supplier#999999999'), ('T-N04', 'Supplier#888888888')) q(id, supplier_name)
LEFT JOIN (SELECT s.s_name AS supplier_name, COUNT(*) AS n_lines FROM lineitem l JOIN supplier s
           ON l.l_suppkey = s.s_suppkey GROUP BY s.s_name) c
  ON q.supplier_name = c.supplier_name
""")(lambda spark, d: Q.unknown_entity_lines(_sem(spark, d)))


# --- D: truth -----------------------------------------------------------------------------------

def truth_sql(ids: list[str] | None = None) -> str:
    qs = [q for q in Q.QUESTIONS if ids is None or q.id in ids]
    parts = []
    for q in qs:
        if q.id not in Q_SQL:
            continue
        kind, sql = Q_SQL[q.id]
        if kind == "num":
            parts.append(f"SELECT '{q.id}' AS id, CAST(NULL AS VARCHAR) AS value_text, "
                         f"ROUND(CAST(answer AS DOUBLE), 2) AS value_num FROM ({sql}) t")
        elif kind == "text":
            parts.append(f"SELECT '{q.id}', CAST(answer AS VARCHAR), CAST(NULL AS DOUBLE) FROM ({sql}) t")
        else:
            parts.append(f"SELECT '{q.id}', CAST(answer AS VARCHAR), CAST(NULL AS DOUBLE) FROM ({sql}) t "
                         f"WHERE answer IS NOT NULL")
    def lit(v):
        return "NULL" if v is None else f"'{v}'"
    meta = ", ".join(f"('{q.id}', '{q.category}', '{q.answer_type}', {lit(q.split)})" for q in qs)
    union = "\nUNION ALL ".join(parts)
    return f"""
WITH vals AS ({union}),
meta AS (SELECT * FROM (VALUES {meta}) m(id, category, answer_type, split)),
counts AS (SELECT id, CAST(COUNT(COALESCE(value_text, CAST(value_num AS VARCHAR))) AS INTEGER) AS n_values
           FROM vals GROUP BY id)
SELECT m.id, m.category, m.answer_type, CAST(m.split AS VARCHAR) AS split, v.value_text, v.value_num,
       COALESCE(c.n_values, 0) AS n_values
FROM meta m LEFT JOIN vals v ON m.id = v.id LEFT JOIN counts c ON m.id = c.id"""


register("truth_table", truth_sql())(lambda spark, d: TR.truth_table(_sem(spark, d)))

register("truth_sets_sorted", f"""
SELECT id, row_number() OVER (PARTITION BY id ORDER BY value_text) AS position, value_text, n_values
FROM ({truth_sql()}) t WHERE answer_type = 'set' AND value_text IS NOT NULL
""")(lambda spark, d: TR.sorted_sets(TR.truth_table(_sem(spark, d))))


# --- E: answer scoring ----------------------------------------------------------------------------

from quarry.functions import scoring as S  # noqa: E402
from quarry.operators import scorecard as SC  # noqa: E402
from quarry.sources import derived as D  # noqa: E402

WS = S.PY_WHITESPACE_CLASS


def _strip_sql(x: str) -> str:
    return f"trim({x}, {_ws_chars_sql()})"


def _ws_chars_sql() -> str:
    return " || ".join(f"chr({ord(ch)})" for ch in S.PY_WHITESPACE_CHARS)




def _norm_sql(x: str) -> str:
    return f"lower(trim(regexp_replace(COALESCE({x}, ''), '{WS}', ' ', 'g')))"


def _nums_sql(x: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all(COALESCE({x}, ''), '{S.NUMBER_PATTERN}'), "
            f"lambda t: TRY_CAST(replace(t, ',', '') AS DOUBLE)), lambda v: v IS NOT NULL)")


@register("norm_text", f"""
SELECT doc_id, CAST(length({_norm_sql('text')}) AS INTEGER) AS norm_len, md5({_norm_sql('text')}) AS norm_md5 FROM documents
""")
def _norm_text(spark, d):
    n = S.norm("text")
    return Catalog(spark, d).documents.select("doc_id", F.length(n).alias("norm_len"), F.md5(n).alias("norm_md5"))


@register("extract_numbers", f"""
SELECT doc_id, CAST(len(nums) AS INTEGER) AS n_numbers, nums[1] AS first_number, list_max(nums) AS max_number
FROM (SELECT doc_id, {_nums_sql('text')} AS nums FROM documents) t
""")
def _extract_numbers(spark, d):
    nums = S.extract_numbers("text")
    return (Catalog(spark, d).documents.select("doc_id", nums.alias("nums"))
            .select("doc_id", F.size("nums").alias("n_numbers"), F.try_element_at("nums", F.lit(1)).alias("first_number"),
                    F.array_max("nums").alias("max_number")))


_TOL = "greatest(0.01, abs(expected) * 0.01)"


@register("score_scalar_numeric", f"""
SELECT task_id, expected,
       len(list_filter(nums, lambda v: abs(v - expected) <= {_TOL})) > 0 AS correct,
       list_filter(nums, lambda v: abs(v - expected) <= {_TOL})[1] AS matched_number
FROM (SELECT task_id, expected, {_nums_sql('answer')} AS nums FROM ({D.SCALAR_ANSWERS_SQL}) a) t
""")
def _score_scalar_numeric(spark, d):
    a = D.scalar_answers(Catalog(spark, d))
    return a.select("task_id", "expected", S.score_scalar_numeric("answer", "expected").alias("correct"),
                    S.matched_number("answer", "expected").alias("matched_number"))


def _type_answers(catalog):
    p = catalog.part.select("p_partkey", "p_name", "p_type")
    stated = F.when(F.col("p_partkey") % 11 == 0, F.lit("standard")).otherwise(F.col("p_type"))
    text = F.when(F.col("p_partkey") % 5 == 0,
                  F.concat(F.lit("Type:\t"), F.lower(stated), F.lit("  (part "), F.col("p_name"), F.lit(")")))\
        .otherwise(F.concat(F.lit("The part "), F.col("p_name"), F.lit(" is of type "), stated))
    return p.select(F.col("p_partkey").alias("task_id"), F.col("p_type").alias("expected"), text.alias("answer"))


TYPE_ANSWERS_SQL = """
SELECT p_partkey AS task_id, p_type AS expected,
       CASE WHEN p_partkey % 5 = 0
            THEN 'Type:' || chr(9) || lower(CASE WHEN p_partkey % 11 = 0 THEN 'standard' ELSE p_type END)
                 || '  (part ' || p_name || ')'
            ELSE 'The part ' || p_name || ' is of type ' || CASE WHEN p_partkey % 11 = 0 THEN 'standard' ELSE p_type END
       END AS answer
FROM part"""


@register("score_scalar_text", f"""
SELECT task_id, expected, contains({_norm_sql('answer')}, {_norm_sql('expected')}) AS correct
FROM ({TYPE_ANSWERS_SQL}) a
""")
def _score_scalar_text(spark, d):
    a = _type_answers(Catalog(spark, d))
    return a.select("task_id", "expected", S.score_scalar_text("answer", "expected").alias("correct"))


SET_ANSWERS_SQL = """
SELECT c_nationkey AS task_id, expected_values,
       'Segments: ' || array_to_string(CASE WHEN c_nationkey % 4 = 0 THEN expected_values[2:] ELSE expected_values END,
                                       ', ') AS answer
FROM (SELECT c_nationkey, list_sort(list(c_mktsegment)) AS expected_values
      FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) s GROUP BY c_nationkey) g"""


@register("score_set_recall", f"""
SELECT task_id, CAST(len(expected_values) AS INTEGER) AS n_expected,
       CAST(len(list_filter(expected_values, lambda v: contains({_norm_sql('answer')}, {_norm_sql('v')}))) AS INTEGER)
         AS n_found,
       CASE WHEN len(expected_values) = 0 THEN 1.0
            ELSE len(list_filter(expected_values, lambda v: contains({_norm_sql('answer')}, {_norm_sql('v')})))
                 / len(expected_values) END AS recall,
       (CASE WHEN len(expected_values) = 0 THEN 1.0
            ELSE len(list_filter(expected_values, lambda v: contains({_norm_sql('answer')}, {_norm_sql('v')})))
                 / len(expected_values) END) >= 0.999 AS correct,
       array_to_string(list_filter(expected_values,
                       lambda v: NOT contains({_norm_sql('answer')}, {_norm_sql('v')}))[1:5], '|') AS missing_head
FROM ({SET_ANSWERS_SQL}) a
""")
def _score_set_recall(spark, d):
    a = D.set_answers(Catalog(spark, d))
    return a.select("task_id", F.size("expected_values").alias("n_expected"),
                    F.size(S.set_found("answer", "expected_values")).alias("n_found"),
                    S.set_recall("answer", "expected_values").alias("recall"),
                    S.set_correct("answer", "expected_values").alias("correct"),
                    F.array_join(F.slice(S.set_missing("answer", "expected_values"), 1, 5), "|").alias("missing_head"))


@register("score_large_sets", f"""
WITH m AS (SELECT c_nationkey AS task_id, c_custkey AS position, c_name AS value FROM customer),
a AS (SELECT c_nationkey AS task_id, 'Customers:' || chr(9) || string_agg(upper(c_name), ' and ' ORDER BY c_custkey) AS answer
      FROM customer WHERE c_custkey % 4 <> 0 GROUP BY c_nationkey),
f AS (SELECT m.task_id, position, value, contains({_norm_sql('answer')}, {_norm_sql('value')}) AS found FROM m JOIN a ON m.task_id = a.task_id)
SELECT task_id, COUNT(*) AS n_expected, COUNT(*) FILTER (found) AS n_found, COUNT(*) FILTER (found) / COUNT(*)::DOUBLE AS recall,
       COUNT(*) FILTER (found) / COUNT(*)::DOUBLE >= 0.999 AS correct,
       COALESCE(array_to_string(list(value ORDER BY position) FILTER (NOT found)[1:5], '|'), '') AS missing_head
FROM f GROUP BY task_id
""")
def _score_large_sets(spark, d):
    from quarry.operators.set_recall import long_set_recall

    c = Catalog(spark, d).customer
    members = c.select(F.col("c_nationkey").alias("task_id"), F.col("c_custkey").alias("position"), F.col("c_name").alias("value"))
    # an answer is one text: its names are gathered into one row, like any answer's
    named = c.where("c_custkey % 4 <> 0").groupBy(F.col("c_nationkey").alias("task_id")).agg(
        F.array_sort(F.collect_list(F.struct("c_custkey", F.upper("c_name").alias("name")))).alias("names"))
    answers = named.select("task_id", F.concat(F.lit("Customers:\t"), F.array_join(F.col("names.name"), " and ")).alias("answer"))
    return long_set_recall(answers, members).withColumn("missing_head", F.array_join("missing", "|")).drop("missing")


_PHRASES_SQL = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in S.REFUSAL_PHRASES) + "]"
REFUSALS_SQL = """
SELECT conv_id, turn, text AS answer, CASE WHEN turn % 5 = 0 THEN turn % 10 = 0 END AS verdict
FROM conversations WHERE role = 'assistant'"""


@register("score_refusal", f"""
SELECT conv_id, turn, verdict,
       len(list_filter({_PHRASES_SQL}, lambda p: contains({_norm_sql('answer')}, p))) > 0 AS heuristic,
       COALESCE(verdict, len(list_filter({_PHRASES_SQL}, lambda p: contains({_norm_sql('answer')}, p))) > 0) AS refused
FROM ({REFUSALS_SQL}) r
""")
def _score_refusal(spark, d):
    a = D.refusal_answers(Catalog(spark, d))
    return a.select("conv_id", "turn", "verdict", S.refusal_heuristic("answer").alias("heuristic"),
                    S.score_refusal("answer", "verdict").alias("refused"))


@register("score_tasks", f"""
SELECT 'c' || CAST(task_id AS VARCHAR) AS task_key, 'scalar' AS answer_type,
       len(list_filter({_nums_sql('answer')}, lambda v: abs(v - expected) <= {_TOL})) > 0 AS correct
FROM ({D.SCALAR_ANSWERS_SQL}) a
UNION ALL
SELECT 'n' || CAST(task_id AS VARCHAR), 'set',
       (CASE WHEN len(expected_values) = 0 THEN 1.0
            ELSE len(list_filter(expected_values, lambda v: contains({_norm_sql('answer')}, {_norm_sql('v')})))
                 / len(expected_values) END) >= 0.999
FROM ({SET_ANSWERS_SQL}) s
UNION ALL
SELECT 'v' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), 'refusal',
       COALESCE(verdict, len(list_filter({_PHRASES_SQL}, lambda p: contains({_norm_sql('answer')}, p))) > 0)
FROM ({REFUSALS_SQL}) r
""")
def _score_tasks(spark, d):
    cat = Catalog(spark, d)
    # each kind is scored in its own branch, so a branch only evaluates its own rule
    sc = D.scalar_answers(cat).select(F.concat(F.lit("c"), F.col("task_id").cast("string")).alias("task_key"),
                                      F.lit("scalar").alias("answer_type"),
                                      S.score_scalar_numeric("answer", "expected").alias("correct"))
    st = D.set_answers(cat).select(F.concat(F.lit("n"), F.col("task_id").cast("string")).alias("task_key"),
                                   F.lit("set").alias("answer_type"), S.set_correct("answer", "expected_values").alias("correct"))
    rf = D.refusal_answers(cat).select(
        F.concat(F.lit("v"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("task_key"),
        F.lit("refusal").alias("answer_type"), S.score_refusal("answer", "verdict").alias("correct"))
    return sc.unionByName(st).unionByName(rf)


_SCORED_KINDS = f"""
SELECT 'c' || CAST(task_id AS VARCHAR) AS task_key, 'scalar' AS answer_type, task_id, answer, CAST(expected AS DOUBLE) AS expected_num,
       CAST(NULL AS VARCHAR) AS expected_text, CAST(NULL AS VARCHAR[]) AS expected_values, CAST(NULL AS BOOLEAN) AS judged
FROM ({D.SCALAR_ANSWERS_SQL}) a
UNION ALL SELECT 'p' || CAST(task_id AS VARCHAR), 'scalar', task_id, answer, NULL, expected, NULL, NULL FROM ({TYPE_ANSWERS_SQL}) b
UNION ALL SELECT 'n' || CAST(task_id AS VARCHAR), 'set', task_id, answer, NULL, NULL, expected_values, NULL FROM ({SET_ANSWERS_SQL}) c
UNION ALL SELECT 'v' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), 'refusal', conv_id, answer, NULL, NULL, NULL, verdict
          FROM ({REFUSALS_SQL}) d"""


@register("task_records", f"""
WITH e AS (SELECT *, CASE WHEN task_id % 13 = 0 THEN 'timeout' END AS error FROM ({_SCORED_KINDS}) k),
w AS (SELECT * REPLACE (CASE WHEN error IS NOT NULL AND task_id % 2 = 0 THEN NULL ELSE answer END AS answer,
                        CASE WHEN error IS NULL THEN judged END AS judged) FROM e),
f AS (SELECT *, {_nums_sql('answer')} AS nums,
             list_filter(expected_values, lambda v: contains({_norm_sql('answer')}, {_norm_sql('v')})) AS found,
             list_filter(expected_values, lambda v: NOT contains({_norm_sql('answer')}, {_norm_sql('v')})) AS missing,
             len(list_filter({_PHRASES_SQL}, lambda p: contains({_norm_sql('answer')}, p))) > 0 AS refuses FROM w),
r AS (SELECT *, list_filter(nums, lambda v: abs(v - expected_num) <= greatest(0.01, abs(expected_num) * 0.01))[1] AS hit,
             CASE WHEN answer_type = 'set' THEN CASE WHEN len(expected_values) = 0 THEN 1.0::DOUBLE ELSE len(found) / len(expected_values)::DOUBLE END END
               AS set_recall FROM f)
SELECT task_key, answer_type, error,
       CASE WHEN answer_type = 'set' THEN set_recall >= 0.999 WHEN answer_type = 'refusal' THEN COALESCE(judged, refuses)
            WHEN expected_num IS NOT NULL THEN hit IS NOT NULL ELSE contains({_norm_sql('answer')}, {_norm_sql('expected_text')}) END AS correct,
       judged AS judge_correct, set_recall,
       CASE WHEN answer_type = 'set' THEN 'recall ' || printf('%.2f', set_recall) || CASE WHEN len(missing) > 0 THEN ', missing [' || chr(39)
                 || array_to_string(missing[1:5], chr(39) || ', ' || chr(39)) || chr(39) || ']' ELSE '' END
            WHEN answer_type = 'refusal' THEN 'refusal: judge-primary' || CASE WHEN judged IS NULL THEN ' (heuristic)' ELSE '' END
            WHEN expected_num IS NULL THEN 'substring match for ' || chr(39) || expected_text || chr(39)
            WHEN hit IS NOT NULL THEN 'found ' || CAST(hit AS VARCHAR) || ' within tol of ' || CAST(expected_num AS VARCHAR)
            ELSE 'expected ' || CAST(expected_num AS VARCHAR) || ' not found among numbers in answer' END AS detail
FROM r
""")
def _task_records(spark, d):
    cat = Catalog(spark, d)
    sc, tx, st, rf = D.scalar_answers(cat), _type_answers(cat), D.set_answers(cat), D.refusal_answers(cat)
    key = lambda letter, *cols: F.concat_ws(":", F.concat(F.lit(letter), F.col(cols[0]).cast("string")), *[F.col(c).cast("string") for c in cols[1:]])
    kinds = [sc.select(key("c", "task_id").alias("task_key"), F.lit("scalar").alias("answer_type"), "task_id", "answer", F.col("expected").alias("expected_num")),
             tx.select(key("p", "task_id").alias("task_key"), F.lit("scalar").alias("answer_type"), "task_id", "answer", F.col("expected").alias("expected_text")),
             st.select(key("n", "task_id").alias("task_key"), F.lit("set").alias("answer_type"), "task_id", "answer", "expected_values"),
             rf.select(key("v", "conv_id", "turn").alias("task_key"), F.lit("refusal").alias("answer_type"), F.col("conv_id").alias("task_id"), "answer",
                       F.col("verdict").alias("judge_correct"))]

    def with_errors(df):
        df = df.withColumn("error", F.when(F.col("task_id") % 13 == 0, F.lit("timeout")))
        return df.withColumn("answer", F.when(F.col("error").isNull() | (F.col("task_id") % 2 != 0), F.col("answer")))

    return S.score_answers([with_errors(k) for k in kinds]).select("task_key", "answer_type", "error", "correct", "judge_correct", "set_recall", "detail")


_GROUNDED_SQL = ("(lower(COALESCE(tool_type, 'none')) LIKE '%fabric%' OR lower(COALESCE(tool_name, 'none')) LIKE "
                 "'%fabric%' OR lower(COALESCE(tool_type, 'none')) LIKE '%mcp%')")

SCORED_LOG_SQL = f"""
SELECT r.*, {_GROUNDED_SQL} AS called_kb,
       CASE WHEN category = 'multi_hop' THEN {_GROUNDED_SQL} AND correct END AS traversal_ok,
       round_even(input_tokens / 1000000.0 * COALESCE(p.input_rate, CAST({D.DEFAULT_PRICE[0]} AS DOUBLE))
                  + output_tokens / 1000000.0 * COALESCE(p.output_rate, CAST({D.DEFAULT_PRICE[1]} AS DOUBLE)), 8) AS cost_usd
FROM ({D.RUN_LOG_SQL}) r LEFT JOIN {D.PRICES_SQL} ON r.model = p.model"""


def _scored(spark, d):
    return SC.scored_run_log(Catalog(spark, d), spark)


@register("grounding_flags", f"""
SELECT task_id, model, called_kb, CAST(1 AS INTEGER) AS tool_call_count, has_rows FROM ({SCORED_LOG_SQL}) t
""")
def _grounding_flags(spark, d):
    return _scored(spark, d).select("task_id", "model", "called_kb", "tool_call_count", "has_rows")


@register("task_cost", f"SELECT task_id, model, cost_usd FROM ({SCORED_LOG_SQL}) t")
def _task_cost(spark, d):
    return _scored(spark, d).select("task_id", "model", "cost_usd")


register("price_fallback_join", f"""
SELECT m.model, COALESCE(p.input_rate, CAST({D.DEFAULT_PRICE[0]} AS DOUBLE)) AS input_rate,
       COALESCE(p.output_rate, CAST({D.DEFAULT_PRICE[1]} AS DOUBLE)) AS output_rate, p.model IS NULL AS used_default
FROM (SELECT DISTINCT 'm' || CAST(event_id % 4 AS VARCHAR) AS model FROM events) m LEFT JOIN {D.PRICES_SQL}
  ON m.model = p.model
""")(lambda spark, d: SC.priced(
    Catalog(spark, d).events.select(F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("model"))
    .distinct().join(D.prices(spark).select("model", F.lit(False).alias("used_default")), "model", "left"),
    D.prices(spark)).select("model", "input_rate", "output_rate",
                            F.coalesce("used_default", F.lit(True)).alias("used_default")))


@register("verdict_agreement", f"""
SELECT correct AS sql_correct, judge_correct, COUNT(*) AS n FROM ({D.RUN_LOG_SQL}) t GROUP BY correct, judge_correct
""")
def _verdict_agreement(spark, d):
    return (D.run_log(Catalog(spark, d)).groupBy(F.col("correct").alias("sql_correct"), "judge_correct")
            .agg(F.count(F.lit(1)).alias("n")))


# --- F: scorecards ----------------------------------------------------------------------------------

SCORECARD_SQL = f"""
SELECT model, n_tasks, correct,
       CASE WHEN n_tasks > 0 THEN round_even(100.0 * correct / n_tasks, 1) ELSE 0.0 END AS overall_pct,
       tokens_in, tokens_out, tokens_in + tokens_out AS tokens_total,
       round_even((tokens_in + tokens_out) / n_tasks, 1) AS tokens_avg,
       round_even(cost, 6) AS cost_total, round_even(cost / n_tasks, 6) AS cost_avg,
       CASE WHEN correct > 0 THEN round_even(cost / correct, 6) END AS cost_per_correct,
       CAST(round_even(lat / n_tasks, 0) AS BIGINT) AS latency_avg,
       round_even(100.0 * grounded / n_tasks, 1) AS grounded_pct,
       CASE WHEN multi_hop_n > 0 THEN round_even(100.0 * trav / multi_hop_n, 1) ELSE 0.0 END AS traversal_pct,
       multi_hop_n, n_config_hashes = 1 AS single_config, n_config_hashes, config_hash_min
FROM (SELECT model, COUNT(*) AS n_tasks, SUM(CAST(correct AS INTEGER)) AS correct,
             SUM(input_tokens) AS tokens_in, SUM(output_tokens) AS tokens_out, SUM(cost_usd) AS cost,
             SUM(latency_ms) AS lat, SUM(CAST(called_kb AS INTEGER)) AS grounded,
             SUM(CAST(COALESCE(traversal_ok, FALSE) AS INTEGER)) AS trav,
             SUM(CAST(category = 'multi_hop' AS INTEGER)) AS multi_hop_n,
             COUNT(DISTINCT config_hash) AS n_config_hashes, MIN(config_hash) AS config_hash_min
      FROM ({SCORED_LOG_SQL}) t GROUP BY model) a"""

register("scorecard", SCORECARD_SQL)(lambda spark, d: SC.scorecard(_scored(spark, d)))


@register("latency_percentiles", f"""
SELECT model, n AS n_tasks,
       MAX(CASE WHEN rn = n // 2 THEN latency_ms END) AS p50,
       MAX(CASE WHEN rn = least(n - 1, CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT)) THEN latency_ms END) AS p95,
       MAX(latency_ms) AS max
FROM (SELECT model, latency_ms, row_number() OVER (PARTITION BY model ORDER BY latency_ms) - 1 AS rn,
             COUNT(*) OVER (PARTITION BY model) AS n FROM ({D.RUN_LOG_SQL}) r) s
GROUP BY model, n
""")
def _latency_percentiles(spark, d):
    return SC.latency_percentiles(D.run_log(Catalog(spark, d)))


@register("scorecard_by_category", f"""
SELECT model, COALESCE(category, 'ALL') AS category, COUNT(*) AS n, SUM(CAST(correct AS INTEGER)) AS correct,
       round_even(100.0 * SUM(CAST(correct AS INTEGER)) / COUNT(*), 1) AS pct, GROUPING(category) > 0 AS is_total
FROM ({D.RUN_LOG_SQL}) r GROUP BY ROLLUP (model, category) HAVING GROUPING(model) = 0
""")
def _scorecard_by_category(spark, d):
    return SC.scorecard_by_category(D.run_log(Catalog(spark, d)))


@register("config_uniformity", f"""
SELECT model, COUNT(DISTINCT config_hash) AS n_hashes, MIN(config_hash) AS hash_min,
       COUNT(DISTINCT config_hash) = 1 AS single_config,
       (SELECT COUNT(DISTINCT config_hash) FROM ({D.RUN_LOG_SQL}) x) = 1 AS shared_across_runs,
       (SELECT COUNT(DISTINCT config_hash) = 1 AND MIN(config_hash) = 'f9a15da1' FROM ({D.RUN_LOG_SQL}) x) AS equals_pinned
FROM ({D.RUN_LOG_SQL}) r GROUP BY model
""")
def _config_uniformity(spark, d):
    return SC.config_uniformity(D.run_log(Catalog(spark, d)), expected=D.CONFIG_HASH)


@register("tuning_summary", f"""
SELECT model, split, COUNT(*) AS n, SUM(CAST(correct AS INTEGER)) AS correct,
       SUM(input_tokens + output_tokens) AS tokens, SUM(CAST(category = 'negative' AS INTEGER)) AS neg_n,
       SUM(CAST(category = 'negative' AND correct AS INTEGER)) AS neg_correct,
       round_even(100.0 * SUM(CAST(correct AS INTEGER)) / COUNT(*), 2) AS accuracy_pct
FROM ({D.RUN_LOG_SQL}) r GROUP BY model, split
""")
def _tuning_summary(spark, d):
    return SC.tuning_summary(D.run_log(Catalog(spark, d)), ["model", "split"])


# --- G: run comparison ----------------------------------------------------------------------------

from quarry.operators import compare as CMP  # noqa: E402

ANCHOR = "m0"
RUNS = ["m0", "m1", "m2", "m3"]
MATRIX_METRICS = ["overall_pct", "tokens_total", "tokens_avg", "cost_total", "cost_per_correct", "latency_avg",
                  "grounded_pct", "traversal_pct"]
BOOT_RESAMPLES, BOOT_SEED = 10_000, 20260731

ALL_PAIRS_SQL = f"""
SELECT r.model AS challenger, r.task_id, CAST(r.correct AS INTEGER) AS a_correct, CAST(a.correct AS INTEGER) AS b_correct
FROM ({D.RUN_LOG_SQL}) r JOIN ({D.RUN_LOG_SQL}) a ON a.task_id = r.task_id AND a.model = '{ANCHOR}'
WHERE r.model <> '{ANCHOR}'"""


def _cards(spark, d):
    return SC.scorecard(_scored(spark, d))


register("metric_matrix", "SELECT metric, " + ", ".join(
    f"MAX(CASE WHEN model = '{m}' THEN value END) AS {m}" for m in RUNS) + " FROM (" + " UNION ALL ".join(
    f"SELECT model, '{x}' AS metric, CAST({x} AS DOUBLE) AS value FROM ({SCORECARD_SQL}) s" for x in MATRIX_METRICS)
    + ") u GROUP BY metric")(lambda spark, d: CMP.metric_matrix(_cards(spark, d), MATRIX_METRICS, RUNS))

MATRIX_CATEGORIES = ["single_hop", "multi_hop", "negative"]
_matrix_names = [*MATRIX_METRICS, *[f"{c}_pct" for c in MATRIX_CATEGORIES], "config_hash"]
register("metric_matrix_full", f"""
WITH u AS (
  {" UNION ALL ".join(f"SELECT model, '{x}' AS metric, printf('%.8f', CAST({x} AS DOUBLE)) AS v FROM ({SCORECARD_SQL}) s WHERE {x} IS NOT NULL" for x in MATRIX_METRICS)}
  UNION ALL SELECT model, category || '_pct', printf('%.8f', CAST(round_even(100.0 * COUNT(*) FILTER (WHERE correct) / COUNT(*), 1) AS DOUBLE))
            FROM ({D.RUN_LOG_SQL}) r WHERE category IN ('single_hop', 'multi_hop', 'negative') GROUP BY model, category
  UNION ALL SELECT model, 'config_hash', substr(MIN(config_hash), 1, 12) FROM ({D.RUN_LOG_SQL}) r GROUP BY model)
SELECT m.metric, {", ".join(f"COALESCE(MAX(CASE WHEN u.model = '{r}' THEN u.v END), '-') AS {r}" for r in RUNS)}
FROM (VALUES {", ".join(f"('{n}')" for n in _matrix_names)}) m(metric) LEFT JOIN u ON u.metric = m.metric GROUP BY m.metric
""")(lambda spark, d: CMP.metric_matrix_text(
    _cards(spark, d), SC.scorecard_by_category(D.run_log(Catalog(spark, d))),
    SC.config_uniformity(D.run_log(Catalog(spark, d))), MATRIX_METRICS, MATRIX_CATEGORIES, RUNS))

register("pareto_check", f"""
SELECT '{ANCHOR}' AS reference, c.model AS challenger, r.overall_pct AS reference_pct, c.overall_pct AS challenger_pct,
       c.overall_pct >= r.overall_pct AS accuracy_ge,
       CASE WHEN r.tokens_total <> 0 THEN round_even(c.tokens_total / r.tokens_total, 3) END AS tokens_ratio,
       CASE WHEN r.cost_total <> 0 THEN round_even(c.cost_total / r.cost_total, 3) END AS cost_ratio,
       r.tokens_total > 0 AND c.tokens_total <= CAST(0.75 AS DOUBLE) * r.tokens_total AS tokens_much_less,
       r.cost_total > 0 AND c.cost_total <= CAST(0.75 AS DOUBLE) * r.cost_total AS cost_much_less,
       c.overall_pct >= r.overall_pct AND r.tokens_total > 0 AND c.tokens_total <= CAST(0.75 AS DOUBLE) * r.tokens_total
         AND r.cost_total > 0 AND c.cost_total <= CAST(0.75 AS DOUBLE) * r.cost_total AS pareto_win
FROM ({SCORECARD_SQL}) c, (SELECT * FROM ({SCORECARD_SQL}) x WHERE model = '{ANCHOR}') r WHERE c.model <> '{ANCHOR}'
""")(lambda spark, d: CMP.pareto_check(_cards(spark, d), ANCHOR))

register("paired_delta",
         f"SELECT challenger, task_id, a_correct, b_correct, a_correct - b_correct AS delta FROM ({ALL_PAIRS_SQL}) p")(
    lambda spark, d: CMP.pair_all(D.run_log(Catalog(spark, d)), ANCHOR).withColumn(
        "delta", F.col("a_correct") - F.col("b_correct")))

def _uniform_sql(stage: int) -> str:
    return (f"(('0x' || substr(md5('{BOOT_SEED}:' || challenger || ':' || CAST(r AS VARCHAR) || ':{stage}'), 1, 13))::BIGINT::DOUBLE + 0.5) "
            f"/ 4503599627370496.0::DOUBLE")


def _binomial_sql(stage: int, left: str, p: str, name: str, source: str) -> str:
    """CTEs that add the column ``name`` to ``source``: the outcome of ``left`` tries of chance ``p`` that a
    uniform number picks, outcomes laid out from the mode (mode, mode + 1, mode - 1, ...)."""
    return f"""
a{stage} AS (SELECT *, {left} AS tries, CASE WHEN {left} > 0 THEN {p} ELSE 0::DOUBLE END AS chance, {_uniform_sql(stage)} AS u FROM {source}),
d{stage} AS (SELECT DISTINCT tries, chance, least(floor((tries + 1) * chance)::BIGINT, tries) AS mode FROM a{stage} WHERE chance > 0 AND chance < 1),
o{stage} AS (SELECT tries, chance, mode, unnest(range(0, tries + 1)) AS k FROM d{stage}),
w{stage} AS (
  SELECT tries, chance, k, sum(exp(lgamma(tries + 1) - lgamma(k + 1) - lgamma(tries - k + 1) + k * ln(chance) + (tries - k) * ln(1 - chance)))
                          OVER (PARTITION BY tries, chance ORDER BY 2 * abs(k - mode) - (k > mode)::INTEGER ROWS UNBOUNDED PRECEDING) AS upto FROM o{stage}),
s{stage} AS (
  SELECT a.* EXCLUDE (tries, chance, u), CASE WHEN a.chance <= 0 THEN 0 WHEN a.chance >= 1 THEN a.tries ELSE w.k END AS {name}
  FROM a{stage} a ASOF LEFT JOIN w{stage} w ON a.tries = w.tries AND a.chance = w.chance AND a.u < w.upto)"""


BOOTSTRAP_SQL = f"""
WITH c AS (SELECT challenger, COUNT(*) AS m, COUNT(*) FILTER (a_correct = 1 AND b_correct = 1) AS c11,
                  COUNT(*) FILTER (a_correct = 1 AND b_correct = 0) AS c10, COUNT(*) FILTER (a_correct = 0 AND b_correct = 1) AS c01
           FROM ({ALL_PAIRS_SQL}) p GROUP BY challenger),
reps AS (SELECT c.*, r FROM c, range({BOOT_RESAMPLES}) t(r)),
{_binomial_sql(0, "m", "c11 / m::DOUBLE", "n11", "reps")},
{_binomial_sql(1, "(m - n11)", "CASE WHEN m > c11 THEN c10 / (m - c11)::DOUBLE ELSE 0 END", "n10", "s0")},
{_binomial_sql(2, "(m - n11 - n10)", "CASE WHEN m > c11 + c10 THEN c01 / (m - c11 - c10)::DOUBLE ELSE 0 END", "n01", "s1")},
per AS (SELECT *, (n11 + n10) / m::DOUBLE * 100::DOUBLE AS a, (n11 + n01) / m::DOUBLE * 100::DOUBLE AS b,
               ((n11 + n10) / m::DOUBLE - (n11 + n01) / m::DOUBLE) * 100::DOUBLE AS d FROM s2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY challenger ORDER BY a, r) - 1 AS ia,
                  row_number() OVER (PARTITION BY challenger ORDER BY b, r) - 1 AS ib,
                  row_number() OVER (PARTITION BY challenger ORDER BY d, r) - 1 AS id FROM per),
ci AS (SELECT challenger, m, c11, c10, c01, {", ".join(
    f"round_even(MAX(CASE WHEN i{c} = {at} THEN {c} END), 1) AS {name}{end}" for c, name in (("a", "acc_a_"), ("b", "acc_b_"), ("d", "ci_"))
    for at, end in ((int(0.025 * BOOT_RESAMPLES), "lo"), (int(0.975 * BOOT_RESAMPLES), "hi")))}
       FROM ranked GROUP BY challenger, m, c11, c10, c01),
obs AS (SELECT *, round_even(CAST(100 AS DOUBLE) * (c11 + c10) / m, 1) AS acc_a_pct, round_even(CAST(100 AS DOUBLE) * (c11 + c01) / m, 1) AS acc_b_pct
        FROM ci)
SELECT challenger AS model_a, '{ANCHOR}' AS model_b, CAST(m AS BIGINT) AS n_paired, CAST({BOOT_RESAMPLES} AS BIGINT) AS resamples,
       acc_a_pct, acc_a_lo, acc_a_hi, acc_b_pct, acc_b_lo, acc_b_hi, round_even(acc_a_pct - acc_b_pct, 1) AS delta_pct, ci_lo, ci_hi,
       ci_lo <= 0 AND ci_hi >= 0 AS includes_zero
FROM obs"""


def _bootstrap_all(spark, d):
    return CMP.paired_bootstrap_vs_anchor(spark, D.run_log(Catalog(spark, d)), ANCHOR, resamples=BOOT_RESAMPLES, seed=BOOT_SEED)


register("paired_bootstrap_ci", BOOTSTRAP_SQL)(_bootstrap_all)

BY_CAT_SQL = f"""
SELECT model, category, COUNT(*) AS n, SUM(CAST(correct AS INTEGER)) AS correct FROM ({D.RUN_LOG_SQL}) r
GROUP BY model, category"""

register("category_vs_anchor", f"""
SELECT c.model, c.category, c.correct, a.correct AS anchor_correct, c.n
FROM ({BY_CAT_SQL}) c JOIN ({BY_CAT_SQL}) a ON a.category = c.category AND a.model = '{ANCHOR}'
WHERE c.model <> '{ANCHOR}'
""")(lambda spark, d: CMP.category_vs_anchor(
    SC.scorecard_by_category(D.run_log(Catalog(spark, d))).where(~F.col("is_total")), ANCHOR))

register("miss_classes", f"""
SELECT r.model, CASE WHEN NOT r.correct AND NOT a.correct THEN 'shared_miss' WHEN NOT r.correct THEN 'contested_miss'
                     WHEN NOT a.correct THEN 'anchor_only_miss' ELSE 'both_correct' END AS miss_class, COUNT(*) AS n
FROM ({D.RUN_LOG_SQL}) r JOIN ({D.RUN_LOG_SQL}) a ON a.task_id = r.task_id AND a.model = '{ANCHOR}'
WHERE r.model <> '{ANCHOR}' GROUP BY 1, 2
""")(lambda spark, d: CMP.miss_classes(D.run_log(Catalog(spark, d)), ANCHOR))

register("flips", f"""
SELECT challenger, task_id, a_correct, b_correct, CASE WHEN a_correct > b_correct THEN 'gained' ELSE 'lost' END AS direction
FROM ({ALL_PAIRS_SQL}) p WHERE a_correct <> b_correct
""")(lambda spark, d: CMP.flips_all(D.run_log(Catalog(spark, d)), ANCHOR))

register("passrate_cube", f"""
SELECT category, has_rows, COUNT(*) AS n, SUM(CAST(correct AS INTEGER)) AS passed,
       CAST(GROUPING(category, has_rows) AS BIGINT) AS grouping,
       round_even(CAST(100 AS DOUBLE) * SUM(CAST(correct AS INTEGER)) / COUNT(*), 1) AS pass_pct
FROM ({D.RUN_LOG_SQL}) r GROUP BY CUBE (category, has_rows)
""")(lambda spark, d: CMP.passrate_cube(D.run_log(Catalog(spark, d)), ["category", "has_rows"]))

COST_CEILING_USD = 50.0

register("cost_projection", f"""
SELECT s.model, a.tokens_in AS anchor_tokens_in, a.tokens_out AS anchor_tokens_out,
       round_even(a.tokens_in / 1e6 * COALESCE(p.input_rate, CAST(1.0 AS DOUBLE))
                  + a.tokens_out / 1e6 * COALESCE(p.output_rate, CAST(5.0 AS DOUBLE)), 4) AS answer_usd,
       round_even((a.tokens_in / 1e6 * COALESCE(p.input_rate, CAST(1.0 AS DOUBLE))
                  + a.tokens_out / 1e6 * COALESCE(p.output_rate, CAST(5.0 AS DOUBLE))) * CAST(2.5 AS DOUBLE), 4) AS projected_usd,
       round_even((a.tokens_in / 1e6 * COALESCE(p.input_rate, CAST(1.0 AS DOUBLE))
                  + a.tokens_out / 1e6 * COALESCE(p.output_rate, CAST(5.0 AS DOUBLE))) * CAST(2.5 AS DOUBLE), 4)
         <= {COST_CEILING_USD} AS within_ceiling
FROM ({SCORECARD_SQL}) s CROSS JOIN (SELECT * FROM ({SCORECARD_SQL}) x WHERE model = '{ANCHOR}') a
LEFT JOIN {D.PRICES_SQL} ON p.model = s.model
""")(lambda spark, d: CMP.cost_projection(_cards(spark, d), D.prices(spark), ANCHOR, 2.5, COST_CEILING_USD))

register("relative_savings", f"""
SELECT c.model, round_even((a.cost_avg - c.cost_avg) / a.cost_avg * 100, 1) AS pct_cheaper_per_query,
       round_even((a.cost_per_correct - c.cost_per_correct) / a.cost_per_correct * 100, 1) AS pct_cheaper_per_correct,
       round_even((a.cost_avg - c.cost_avg) * CAST(1e6 AS DOUBLE), 2) AS saved_per_1m_queries
FROM ({SCORECARD_SQL}) c CROSS JOIN (SELECT * FROM ({SCORECARD_SQL}) x WHERE model = '{ANCHOR}') a
WHERE c.model <> '{ANCHOR}'
""")(lambda spark, d: CMP.relative_savings(_cards(spark, d), ANCHOR))


@register("verdict_clauses", f"""
WITH s AS ({SCORECARD_SQL}), b AS ({BOOTSTRAP_SQL}),
n AS (SELECT model, COUNT(*) FILTER (category = 'negative') AS neg_n, COUNT(*) FILTER (category = 'negative' AND correct) AS neg_correct
      FROM ({D.RUN_LOG_SQL}) r GROUP BY model),
v AS (SELECT b.model_a AS challenger, b.includes_zero AS accuracy_within_noise, s.grounded_pct >= 95.0 AS grounded_ok,
             n.neg_correct = n.neg_n AS refusals_kept, s.cost_total < (SELECT cost_total FROM s WHERE model = '{ANCHOR}') AS cost_lower
      FROM b JOIN s ON s.model = b.model_a JOIN n ON n.model = b.model_a)
SELECT *, accuracy_within_noise AND grounded_ok AND refusals_kept AND cost_lower AS verdict_met FROM v
""")
def _verdict_clauses(spark, d):
    log = D.run_log(Catalog(spark, d))
    return CMP.verdict_clauses(_cards(spark, d), _bootstrap_all(spark, d), SC.tuning_summary(log, ["model"]), ANCHOR)


# --- H: evidence packing --------------------------------------------------------------------------

from quarry.operators import evidence as EV  # noqa: E402


def _cell_sql(x: str) -> str:
    return (f"(CASE WHEN regexp_matches(COALESCE({x}, ''), '[,\"\\r\\n]') "
            f"THEN '\"' || replace(COALESCE({x}, ''), '\"', '\"\"') || '\"' ELSE COALESCE({x}, '') END)")


_ORDER_CELL_SQL = {
    "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_orderstatus": "o_orderstatus",
    "o_totalprice": "printf('%.2f', o_totalprice)", "o_orderpriority": "o_orderpriority",
    "notes": "(o_orderpriority || ', status ' || o_orderstatus)"}


def _block_sql(drop: list[str]) -> str:
    keep = [c for c in EV.ORDER_CELLS if c not in drop]
    return ("'" + ",".join(keep) + "' || chr(10) || " + " || ',' || ".join(_cell_sql(_ORDER_CELL_SQL[c]) for c in keep))


def _blocks(spark, d, drop):
    return EV.order_blocks(Catalog(spark, d), drop)


def _block_text_sql() -> str:
    """The text blocks of ``derived.references`` without price and notes."""
    return ("'o_orderkey,o_orderstatus,o_orderpriority' || chr(10) || CAST(o_orderkey AS VARCHAR) || ',' || "
            "o_orderstatus || ',' || o_orderpriority")


register("evidence_project", f"""
SELECT o_custkey AS question_id, o_orderkey AS ref_no, {_block_sql(['o_totalprice', 'notes'])} AS block FROM orders
""")(lambda spark, d: _blocks(spark, d, ["o_totalprice", "notes"]))

register("evidence_project_text", f"""
SELECT question_id, ref_no, {_block_text_sql()} AS block
FROM (SELECT o_custkey AS question_id, o_orderkey AS ref_no, * FROM orders)
""")(lambda spark, d: D.references(Catalog(spark, d)).select(
    "question_id", "ref_no", EV.project_csv_text(F.col("raw"), ["o_totalprice", "notes", "unknown"]).alias("block")))

register("evidence_cap", """
SELECT question_id, ref_no, shown_no, n_total FROM (
  SELECT o_custkey AS question_id, o_orderkey AS ref_no,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS shown_no,
         COUNT(*) OVER (PARTITION BY o_custkey) AS n_total FROM orders) t WHERE shown_no <= 3
""")(lambda spark, d: EV.cap_blocks(_blocks(spark, d, ["notes"]), 3).select("question_id", "ref_no", "shown_no", "n_total"))

register("evidence_truncate", f"""
SELECT o_custkey AS question_id, o_orderkey AS ref_no, substr({_block_sql(['notes'])}, 1, 60) AS block FROM orders
""")(lambda spark, d: _blocks(spark, d, ["notes"]).select("question_id", "ref_no", EV.truncate(F.col("block"), 60).alias("block")))

_NONWS = EV._NON_WS
COMPOSE_CAP, COMPOSE_CHARS = 5, 120

COMPOSE_SQL = f"""
WITH b AS (SELECT o_custkey AS question_id, o_orderkey AS ref_no, {_block_sql(['notes'])} AS block FROM orders),
r AS (SELECT question_id, ref_no, substr({_strip_sql('block')}, 1, {COMPOSE_CHARS}) AS block,
             row_number() OVER (PARTITION BY question_id ORDER BY ref_no) AS shown_no,
             COUNT(*) OVER (PARTITION BY question_id) AS n_total FROM b),
agg AS (SELECT question_id, string_agg('### reference ' || CAST(shown_no AS VARCHAR) || chr(10) || block, chr(10)
                                       ORDER BY shown_no) AS refs, MAX(n_total) AS n_total, COUNT(*) AS n_shown
        FROM r WHERE shown_no <= {COMPOSE_CAP} GROUP BY question_id),
anyrows AS (SELECT question_id, bool_or(regexp_matches(block, '{_NONWS}')) AS has_rows FROM b GROUP BY question_id),
q AS (SELECT c_custkey AS question_id, 'Which orders did ' || c_name || ' place?' AS question,
             CASE WHEN c_custkey % 97 = 0 THEN 'HTTP 500: upstream timeout' END AS error,
             CASE WHEN c_custkey % 2 = 0 THEN 'Orders of ' || c_name || ' follow.' END AS summary FROM customer),
t AS (SELECT q.question_id, COALESCE(agg.n_total, 0) AS n_total, COALESCE(agg.n_shown, 0) AS n_shown,
             COALESCE(anyrows.has_rows, FALSE) AS has_rows,
             '{EV.HEAD_QUESTION}' || chr(10) || q.question || chr(10) || chr(10) || '{EV.HEAD_EVIDENCE}' || chr(10) ||
             CASE WHEN q.error IS NOT NULL THEN '{EV.ERROR_PREFIX}' || q.error || chr(10) || '{EV.ERROR_TAIL}'
                  WHEN NOT COALESCE(anyrows.has_rows, FALSE) THEN '{EV.NO_ROWS_1}' || chr(10) || '{EV.NO_ROWS_2}'
                  ELSE CASE WHEN length(COALESCE(q.summary, '')) > 0
                            THEN '{EV.HEAD_SUMMARY}' || chr(10) || q.summary || chr(10) || chr(10) ELSE '' END
                       || '{EV.HEAD_ROWS}' || chr(10) || agg.refs
                       || CASE WHEN agg.n_total > agg.n_shown THEN chr(10) || '{EV.NOTE_HEADER}' || chr(10) ||
                               CAST(agg.n_shown AS VARCHAR) || ' of ' || CAST(agg.n_total AS VARCHAR) || '{EV.NOTE_TAIL}'
                               ELSE '' END
             END AS text
      FROM q LEFT JOIN agg ON q.question_id = agg.question_id LEFT JOIN anyrows ON q.question_id = anyrows.question_id)
SELECT question_id, n_total, n_shown, has_rows, CAST(length(text) AS INTEGER) AS text_chars, md5(text) AS text_md5 FROM t"""


@register("evidence_compose", COMPOSE_SQL)
def _evidence_compose(spark, d):
    cat = Catalog(spark, d)
    out = EV.compose_inputs(EV.customer_questions(cat), EV.order_blocks(cat, ["notes"]), include_summary=True,
                            max_rows=COMPOSE_CAP, max_row_chars=COMPOSE_CHARS)
    return out.select("question_id", "n_total", "n_shown", "has_rows", F.length("text").alias("text_chars"),
                      F.md5("text").alias("text_md5"))


CHUNK_CHARS = 512
CHUNKS_SQL = f"""
WITH b AS (SELECT o_custkey AS question_id, o_orderkey AS ref_no, {_strip_sql(_block_sql(['notes']))} AS block,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no FROM orders),
refs AS (SELECT question_id, string_agg(chr(10) || '### reference ' || CAST(no AS VARCHAR) || chr(10) || block, '' ORDER BY no) AS refs
         FROM b GROUP BY question_id),
t AS (SELECT c_custkey AS question_id,
             '# Question' || chr(10) || 'Which orders did ' || c_name || ' place?' || chr(10) || chr(10) ||
             '# Grounded ontology evidence (AUTHORITATIVE — answer ONLY from this)' || chr(10) ||
             CASE WHEN c_custkey % 97 = 0 THEN 'RETRIEVAL ERROR: HTTP 500: upstream timeout' || chr(10) ||
                       'NO ROWS were returned. You must reply that the data is unavailable.'
                  WHEN refs IS NULL THEN 'NO ROWS were returned for this question.' || chr(10) ||
                       'You must reply that the data is unavailable; do NOT fabricate an answer.'
                  ELSE CASE WHEN c_custkey % 2 = 0
                            THEN '## Retrieval summary' || chr(10) || 'Orders of ' || c_name || ' follow.' || chr(10) || chr(10)
                            ELSE '' END || '## Verbatim rows (CSV)' || refs END AS text
      FROM customer LEFT JOIN refs ON question_id = c_custkey),
c AS (SELECT question_id, text, unnest(range(0, (length(text) + 511) // 512)) AS chunk_no FROM t)
SELECT question_id, chunk_no, CAST(length(substr(text, chunk_no * 512 + 1, 512)) AS INTEGER) AS chunk_chars,
       md5(substr(text, chunk_no * 512 + 1, 512)) AS chunk_md5 FROM c"""


@register("evidence_compose_chunks", CHUNKS_SQL)
def _evidence_compose_chunks(spark, d):
    cat = Catalog(spark, d)
    out = EV.compose_chunks(EV.customer_questions(cat), EV.order_blocks(cat, ["notes"]), chunk_chars=CHUNK_CHARS)
    return out.select("question_id", "chunk_no", F.length("text").alias("chunk_chars"), F.md5("text").alias("chunk_md5"))


def _json_str_sql(x: str) -> str:
    return ("'\"' || replace(replace(replace(replace(replace(" + x +
            ", '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '\"'")


RESPONSES_SQL = f"""
SELECT o_orderkey AS response_id,
  '{{"references": [{{"sourceData": {{"fabricRawData": ' ||
  {_json_str_sql(f"CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE {_block_sql([])} END")} || '}}}}' ||
  CASE WHEN o_orderkey % 3 <> 0 THEN ', {{"sourceData": {{"fabricAnswer": ' ||
       {_json_str_sql("'Order ' || CAST(o_orderkey AS VARCHAR) || ' is ' || o_orderstatus")} || '}}}}' ELSE '' END ||
  '], "response": [{{"content": [{{"type": "text", "text": ' || {_json_str_sql("'Priority ' || o_orderpriority")} ||
  '}}]}}]}}' AS body
FROM orders"""


@register("references_extract", f"""
SELECT response_id, CAST(json_array_length(body, '$.references') AS INTEGER) AS n_refs,
       CAST(len(blocks) AS INTEGER) AS n_blocks,
       CAST(COALESCE(list_sum(list_transform(blocks, lambda x: length(x))), 0) AS BIGINT) AS blocks_chars,
       COALESCE(list_filter(json_extract_string(body, '$.references[*].sourceData.fabricAnswer'),
                            lambda x: x IS NOT NULL AND length(x) > 0)[1],
                json_extract_string(list_filter(CAST(json_extract(body, '$.response[*].content[*]') AS JSON[]),
                     lambda c: json_extract_string(c, '$.type') = 'text' AND length(json_extract_string(c, '$.text')) > 0)[1],
                     '$.text')) AS synthesized
FROM (SELECT response_id, body, list_filter(json_extract_string(body, '$.references[*].sourceData.fabricRawData'),
                                              lambda x: x IS NOT NULL AND length(x) > 0) AS blocks
      FROM ({RESPONSES_SQL}) r) t
""")
def _references_extract(spark, d):
    ex = EV.extract_references(EV.order_responses(Catalog(spark, d)))
    return ex.select("response_id", "n_refs", F.size("blocks").alias("n_blocks"),
                     F.aggregate("blocks", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("blocks_chars"),
                     "synthesized")


def _edit_json(k: Column) -> Column:
    return F.concat(F.lit('{"max_rows": "'), (k % 10).cast("string"), F.lit('", "bogus": "x"'),
                    F.when(k % 3 == 0, F.lit(', "include_synthesized_answer": "false"')).otherwise(F.lit("")),
                    F.when(k % 5 == 0, F.concat(F.lit(', "max_row_chars": "'), (k * 7).cast("string"), F.lit('"')))
                    .otherwise(F.lit("")), F.lit("}"))


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@register("config_overlay", f"""
SELECT event_id AS cid, CASE WHEN {_K} % 3 = 0 THEN 'false' ELSE 'true' END AS include_synthesized_answer,
       CAST({_K} % 10 AS VARCHAR) AS max_rows, '' AS drop_columns,
       CASE WHEN {_K} % 5 = 0 THEN CAST({_K} * 7 AS VARCHAR) END AS max_row_chars
FROM events
""")
def _config_overlay(spark, d):
    ev = Catalog(spark, d).events.select(F.col("event_id").alias("cid"),
                                         _edit_json(F.get_json_object("props", "$.k").cast("int")).alias("edit"))
    return EV.resolved_config(ev, "edit").drop("edit")


TRIM_DROP, TRIM_CHARS = ["o_totalprice", "notes"], 40

register("trim_effect", f"""
SELECT question_id, full_chars, trimmed_chars, round_even(CAST(100 AS DOUBLE) * (full_chars - trimmed_chars) / full_chars, 1)
       AS saved_pct, is_total
FROM (SELECT o_custkey AS question_id, SUM(length({_block_sql([])})) AS full_chars,
             SUM(length(substr({_block_sql(TRIM_DROP)}, 1, {TRIM_CHARS}))) AS trimmed_chars,
             GROUPING(o_custkey) > 0 AS is_total
      FROM orders GROUP BY ROLLUP (o_custkey)) t
""")(lambda spark, d: (
    EV.order_block_variants(Catalog(spark, d), {"block": [], "trimmed": TRIM_DROP})
    .rollup("question_id").agg(F.sum(F.length("block")).alias("full_chars"),
                               F.sum(F.length(EV.truncate(F.col("trimmed"), TRIM_CHARS))).alias("trimmed_chars"),
                               (F.grouping_id() > 0).alias("is_total"))
    .select("question_id", "full_chars", "trimmed_chars",
            F.bround(F.lit(100.0) * (F.col("full_chars") - F.col("trimmed_chars")) / F.col("full_chars"), 1).alias("saved_pct"),
            "is_total")))


def _config_fields(k: Column):
    return [("instructions", F.concat(F.lit("Answer only from evidence.\nVariant "), (k % 5).cast("string")), "str"),
            ("tools", F.concat(F.lit('{"grounding": {"description": "kb v'), (k % 3).cast("string"), F.lit('"}}')), "str"),
            ("skills", F.array(F.concat(F.lit("skill-"), (k % 3).cast("string"))), "str_array"),
            ("injection", F.when(k % 4 == 0, F.concat(F.lit('{"max_rows": '), (k % 10).cast("string"), F.lit("}"))), "str")]


register("config_hash", f"""
SELECT event_id AS cid, sha256('{{' || CASE WHEN {_K} % 4 = 0 THEN '"injection": ' ||
         {_json_str_sql("'{\"max_rows\": ' || CAST(" + _K + " % 10 AS VARCHAR) || '}'")} || ', ' ELSE '' END ||
       '"instructions": ' || {_json_str_sql("'Answer only from evidence.' || chr(10) || 'Variant ' || CAST(" + _K + " % 5 AS VARCHAR)")} ||
       ', "skills": [' || {_json_str_sql("'skill-' || CAST(" + _K + " % 3 AS VARCHAR)")} || '], "tools": ' ||
       {_json_str_sql("'{\"grounding\": {\"description\": \"kb v' || CAST(" + _K + " % 3 AS VARCHAR) || '\"}}'")} || '}}') AS config_hash
FROM events
""")(lambda spark, d: Catalog(spark, d).events.select(
    F.col("event_id").alias("cid"),
    EV.config_fingerprint(_config_fields(F.get_json_object("props", "$.k").cast("int"))).alias("config_hash")))

register("evidence_wellformed", f"""
SELECT o_custkey AS question_id, o_orderkey AS ref_no,
       list_contains(string_split(string_split(CASE WHEN o_orderkey % 4 = 0 THEN {_block_sql(['o_orderpriority'])}
                                                     ELSE {_block_sql([])} END, chr(10))[1], ','), 'o_orderpriority')
         AS wellformed
FROM orders
""")(lambda spark, d: (
    EV.order_block_variants(Catalog(spark, d), {"block": [], "thin": ["o_orderpriority"]})
    .select("question_id", "ref_no", EV.header_has(
        F.when(F.col("ref_no") % 4 == 0, F.col("thin")).otherwise(F.col("block")), "o_orderpriority").alias("wellformed"))))


# --- I: tuning-run analytics ----------------------------------------------------------------------

from quarry.operators import tuning as TU  # noqa: E402

_P = "(n.train_acc > w.b_tacc OR (n.train_acc = w.b_tacc AND n.train_tokens < w.b_ttok)) AND n.train_neg >= w.b_tneg"
_A = ("(n.dev_acc > w.b_dacc OR (n.dev_acc = w.b_dacc AND n.dev_tokens < w.b_dtok)) AND n.dev_acc >= w.s_dacc "
      "AND n.dev_neg >= w.s_dneg")

REPLAY_SQL = f"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step_ts, cid) AS step
                     FROM ({D.CANDIDATES_SQL}) x),
w AS (
  SELECT run_id, step, cid, TRUE AS promising, TRUE AS adopted, CAST(NULL AS BIGINT) AS parent_cid, 0 AS depth,
         cid AS b_cid, train_acc AS b_tacc, train_tokens AS b_ttok, train_neg AS b_tneg, dev_acc AS b_dacc,
         dev_tokens AS b_dtok, dev_acc AS s_dacc, dev_neg AS s_dneg
  FROM c WHERE step = 1
  UNION ALL
  SELECT run_id, step, cid, p, a, b_cid, CASE WHEN a THEN depth + 1 ELSE depth END,
         CASE WHEN a THEN cid ELSE b_cid END, CASE WHEN a THEN train_acc ELSE b_tacc END,
         CASE WHEN a THEN train_tokens ELSE b_ttok END, CASE WHEN a THEN train_neg ELSE b_tneg END,
         CASE WHEN a THEN dev_acc ELSE b_dacc END, CASE WHEN a THEN dev_tokens ELSE b_dtok END, s_dacc, s_dneg
  FROM (SELECT n.run_id, n.step, n.cid, n.train_acc, n.train_tokens, n.train_neg, n.dev_acc, n.dev_tokens,
               w.b_cid, w.b_tacc, w.b_ttok, w.b_tneg, w.b_dacc, w.b_dtok, w.s_dacc, w.s_dneg, w.depth,
               ({_P}) AS p, ({_P}) AND ({_A}) AS a
        FROM w JOIN c n ON n.run_id = w.run_id AND n.step = w.step + 1) y
)
SELECT run_id, cid, promising, adopted, parent_cid, depth FROM w"""


def _replay(spark, d):
    return TU.replay_adopt_gate(D.candidates(Catalog(spark, d)))


register("adopt_gate_replay", REPLAY_SQL)(
    lambda spark, d: _replay(spark, d).select("run_id", "cid", "promising", "adopted", "parent_cid", "depth"))

register("candidate_ranking", f"""
SELECT r.run_id, r.cid, c.dev_acc, c.dev_tokens,
       row_number() OVER (PARTITION BY r.run_id ORDER BY c.dev_acc DESC, c.dev_tokens ASC, c.step_ts, c.cid) AS rank
FROM ({REPLAY_SQL}) r JOIN ({D.CANDIDATES_SQL}) c ON r.run_id = c.run_id AND r.cid = c.cid WHERE r.promising
""")(lambda spark, d: TU.candidate_ranking(_replay(spark, d), D.candidates(Catalog(spark, d))))

register("candidate_lineage", f"SELECT run_id, cid, parent_cid, depth FROM ({REPLAY_SQL}) r WHERE adopted")(
    lambda spark, d: TU.candidate_lineage(_replay(spark, d)))

register("recent_rejects", f"""
SELECT run_id, cid, rank FROM (
  SELECT r.run_id, r.cid, CAST(row_number() OVER (PARTITION BY r.run_id ORDER BY c.step_ts DESC, c.cid DESC) AS INTEGER) AS rank
  FROM ({REPLAY_SQL}) r JOIN ({D.CANDIDATES_SQL}) c ON r.run_id = c.run_id AND r.cid = c.cid WHERE NOT r.adopted) t
WHERE rank <= 6
""")(lambda spark, d: TU.recent_rejects(_replay(spark, d), 6))

register("overfit_gap", f"""
SELECT w.run_id, w.cid AS winner_cid, w.depth, c.train_acc, c.dev_acc, c.dev_acc - c.train_acc AS gap
FROM (SELECT run_id, arg_max(cid, depth) AS cid, MAX(depth) AS depth FROM ({REPLAY_SQL}) r WHERE adopted GROUP BY run_id) w
JOIN ({D.CANDIDATES_SQL}) c ON w.run_id = c.run_id AND w.cid = c.cid
""")(lambda spark, d: TU.overfit_gap(_replay(spark, d), D.candidates(Catalog(spark, d))))

register("top3_costly", f"""
SELECT model, task_id, tokens, rank FROM (
  SELECT model, task_id, input_tokens + output_tokens AS tokens,
         CAST(row_number() OVER (PARTITION BY model ORDER BY input_tokens + output_tokens DESC, task_id) AS INTEGER) AS rank
  FROM ({D.RUN_LOG_SQL}) r WHERE split = 'train') t WHERE rank <= 3
""")(lambda spark, d: TU.top_costly(D.run_log(Catalog(spark, d)).where(F.col("split") == "train"), "model", 3))

register("failing_tasks", f"""
SELECT model, task_id, category FROM ({D.RUN_LOG_SQL}) r WHERE split = 'train' AND NOT correct
""")(lambda spark, d: D.run_log(Catalog(spark, d)).where((F.col("split") == "train") & ~F.col("correct"))
     .select("model", "task_id", "category"))


# --- A: contracts, D: truth drift and splits, B: refresh, two-branch, dangling ----------------------

import re as _re  # noqa: E402

from quarry.plans import stale as ST  # noqa: E402
from quarry.sources import contracts as CT  # noqa: E402
from quarry.sources.tables import TABLES  # noqa: E402
from quarry.streaming import refresh as RF  # noqa: E402


def _number_sql(x: str) -> str:
    a = f"abs(CAST({x} AS DOUBLE))"
    e = f"greatest(least(CAST(floor(log2({a})) AS BIGINT), 1023), -1022)"
    m = f"({a} / pow(CAST(2 AS DOUBLE), {e}))"

    def bits(up, scale):
        return f"(({e} + {1022 + up}) * {1 << 52} + CAST({m} * CAST({1 << scale} AS DOUBLE) AS BIGINT))"

    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan(CAST({x} AS DOUBLE)) THEN {2047 << 52} + 1 "
            f"WHEN isinf({a}) THEN CASE WHEN {x} > 0 THEN {2047 << 52} ELSE -{2047 << 52} END WHEN {a} = 0 THEN 0 "
            f"ELSE (CASE WHEN {x} < 0 THEN -1 ELSE 1 END) * CASE WHEN {m} >= 2 THEN {bits(1, 51)} WHEN {m} >= 1 OR {e} = -1022 THEN {bits(0, 52)} "
            f"ELSE {bits(-1, 53)} END END")


def _double_sql(x: str) -> str:
    d = f"CAST({x} AS DOUBLE)"
    whole = f"CAST(trunc({d}) AS BIGINT)"
    return (f"CASE WHEN {d} = 0 OR (abs({d}) < {1 << 63}::DOUBLE AND abs({d}) >= 0.0009765625::DOUBLE) THEN CAST({whole} AS VARCHAR) || ':' || "
            f"CAST(CAST(trunc(({d} - CAST({whole} AS DOUBLE)) * {1 << 62}::DOUBLE) AS BIGINT) AS VARCHAR) "
            f"WHEN {x} IS NOT NULL THEN 'b' || CAST({_number_sql(x)} AS VARCHAR) END")


def _render_sql(name: str, dtype: str) -> str:
    d = dtype.upper()
    if d in ("DOUBLE", "FLOAT"):
        s = _double_sql(name)
    elif d.startswith("TIMESTAMP"):
        s = f"CAST(epoch_us({name}) AS VARCHAR)"
    elif d.endswith("[]"):
        s = f"array_to_string(list_transform({name}, lambda x: coalesce({_double_sql('x')}, 'N')), ',')"
    else:
        s = f"CAST({name} AS VARCHAR)"
    return f"COALESCE(CAST(strlen({s}) AS VARCHAR) || ':' || ({s}), 'N')"


# Column types of the driver tables, as DuckDB reports them (used only to write the oracle text).
_DRIVER_COLUMNS = {
    "region": [("r_regionkey", "INTEGER"), ("r_name", "VARCHAR")],
    "nation": [("n_nationkey", "INTEGER"), ("n_name", "VARCHAR"), ("n_regionkey", "INTEGER")],
    "customer": [("c_custkey", "BIGINT"), ("c_name", "VARCHAR"), ("c_nationkey", "INTEGER"), ("c_acctbal", "DOUBLE"),
                 ("c_mktsegment", "VARCHAR")],
    "supplier": [("s_suppkey", "BIGINT"), ("s_name", "VARCHAR"), ("s_nationkey", "INTEGER"), ("s_acctbal", "DOUBLE")],
    "part": [("p_partkey", "BIGINT"), ("p_name", "VARCHAR"), ("p_brand", "VARCHAR"), ("p_type", "VARCHAR"),
             ("p_size", "INTEGER"), ("p_retailprice", "DOUBLE")],
    "orders": [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "VARCHAR"), ("o_totalprice", "DOUBLE"),
               ("o_orderdate", "TIMESTAMP"), ("o_orderpriority", "VARCHAR")],
    "lineitem": [("l_orderkey", "BIGINT"), ("l_partkey", "BIGINT"), ("l_suppkey", "BIGINT"), ("l_linenumber", "INTEGER"),
                 ("l_quantity", "DOUBLE"), ("l_extendedprice", "DOUBLE"), ("l_discount", "DOUBLE"), ("l_tax", "DOUBLE"),
                 ("l_returnflag", "VARCHAR"), ("l_linestatus", "VARCHAR"), ("l_shipdate", "TIMESTAMP")],
    "events": [("event_id", "BIGINT"), ("ts", "TIMESTAMP"), ("user_id", "BIGINT"), ("event_type", "VARCHAR"),
               ("value", "DOUBLE"), ("props", "VARCHAR")],
    "documents": [("doc_id", "BIGINT"), ("text", "VARCHAR"), ("lang", "VARCHAR"), ("source", "VARCHAR"),
                  ("n_chars", "BIGINT")],
    "embeddings": [("vec_id", "BIGINT"), ("embedding", "FLOAT[]"), ("label", "INTEGER")],
    "pages": [("page_id", "BIGINT"), ("url", "VARCHAR"), ("html", "VARCHAR")],
    "benchmark": [("item_id", "BIGINT"), ("text", "VARCHAR")],
    "labels": [("doc_id", "BIGINT"), ("quality", "INTEGER"), ("toxic", "INTEGER")],
    "conversations": [("conv_id", "BIGINT"), ("turn", "BIGINT"), ("role", "VARCHAR"), ("text", "VARCHAR")],
}

def _half_sql(at: int) -> str:
    return f"CAST(COALESCE(list_sum(list(CAST(('0x' || substr(h, {at}, 16))::UBIGINT AS HUGEINT))), 0) % 18446744073709551616::HUGEINT AS VARCHAR)"


def _fingerprint_sql(table: str, by: str = "") -> str:
    """Rows (by, n_rows, fingerprint) of a table; ``by`` is an SQL expression with its name, or nothing."""
    rows = " || ".join(_render_sql(c, ty) for c, ty in _DRIVER_COLUMNS[table])
    name = by.rsplit(" ", 1)[-1]
    return (f"SELECT {name + ', ' if by else ''}COUNT(*) AS n_rows, {_half_sql(1)} || ':' || {_half_sql(17)} AS fingerprint "
            f"FROM (SELECT {by + ', ' if by else ''}md5({rows}) AS h FROM {table}) x {'GROUP BY ' + name if by else ''}")


register("table_fingerprint", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, * FROM ({_fingerprint_sql(t)}) f" for t in _DRIVER_COLUMNS))(
    lambda spark, d: CT.fingerprints(Catalog(spark, d), list(TABLES)))

_rc_rows = ", ".join(f"('{t}', {('NULL' if a is None else repr(a))}, {lo}, {hi}, {n})" for t, (a, lo, hi, n) in CT.ROW_COUNT_RULES.items())
_rc_names = sorted(set(CT.ROW_COUNT_RULES) | {r[0] for r in CT.ROW_COUNT_RULES.values() if r[0]})
register("row_count_contract", f"""
WITH counts AS ({' UNION ALL '.join(f"SELECT '{t}' AS table_name, COUNT(*) AS actual FROM {t}" for t in _rc_names)}),
spec AS (SELECT * FROM (VALUES {_rc_rows}) s(table_name, anchor, lo, hi, floor_n)),
exp AS (SELECT s.table_name, GREATEST(CAST(floor(s.lo * COALESCE(a.actual, 1)) AS BIGINT), s.floor_n) AS least,
               GREATEST(CAST(ceil(s.hi * COALESCE(a.actual, 1)) AS BIGINT), s.floor_n) AS most
        FROM spec s LEFT JOIN counts a ON a.table_name = s.anchor)
SELECT c.table_name, c.actual, CAST(e.least AS BIGINT) AS least, CAST(e.most AS BIGINT) AS most,
       c.actual BETWEEN e.least AND e.most AS ok
FROM counts c JOIN exp e ON c.table_name = e.table_name
""")(lambda spark, d: CT.row_count_contract(Catalog(spark, d)))

DRIFT_FILTER = "l_shipdate < TIMESTAMP '2001-01-01'"


def _drift_side_sql(sql: str, old: bool) -> str:
    return _re.sub(r"\blineitem\b", f"(SELECT * FROM lineitem WHERE {DRIFT_FILTER})", sql) if old else sql


def _truth_summary_sql(old: bool) -> str:
    return (f"SELECT id, COUNT(*) AS n, SUM(('0x' || substr(md5(COALESCE(value_text, printf('%.2f', value_num), '<null>')), 1, 8))"
            f"::BIGINT) AS fp FROM ({_drift_side_sql(truth_sql(), old)}) t GROUP BY id")


register("truth_drift", f"""
SELECT COALESCE(s.id, f.id) AS id, s.n AS stored_n, f.n AS fresh_n,
       CASE WHEN f.id IS NULL THEN 'missing' WHEN s.id IS NULL THEN 'extra'
            WHEN s.n IS DISTINCT FROM f.n OR s.fp IS DISTINCT FROM f.fp THEN 'changed' END AS status
FROM ({_truth_summary_sql(True)}) s FULL OUTER JOIN ({_truth_summary_sql(False)}) f ON s.id = f.id
WHERE f.id IS NULL OR s.id IS NULL OR s.n IS DISTINCT FROM f.n OR s.fp IS DISTINCT FROM f.fp
""")(lambda spark, d: ST.drift_between(_sem(spark, d), {"lineitem": "l_shipdate < '2001-01-01'"}))

def _sl(x: str) -> str:
    return f"lower({_strip_sql(x)})"


@register("split_overlap", f"""
SELECT 'benchmark' AS kind, doc_id FROM documents
WHERE md5({_sl('text')}) IN (SELECT md5({_sl('text')}) FROM benchmark)
UNION ALL
SELECT 'other_source', doc_id FROM documents WHERE md5({_sl('text')}) IN (
  SELECT h FROM (SELECT DISTINCT md5({_sl('text')}) AS h, source FROM documents) t GROUP BY h HAVING COUNT(*) >= 2)
""")
def _split_overlap(spark, d):
    cat = Catalog(spark, d)
    return TR.overlap_report(cat.documents, cat.benchmark, "doc_id", "source")


TASKS_SQL = f"SELECT DISTINCT task_id, split FROM ({D.RUN_LOG_SQL}) r"


def _tasks(spark, d):
    """The task list: one row per task over the whole log (split is a function of the task)."""
    return D.run_log(Catalog(spark, d)).select("task_id", "split").distinct()


register("split_counts", f"""
SELECT COALESCE(split, 'unspecified') AS split, COUNT(*) AS n FROM ({TASKS_SQL}) t GROUP BY 1
""")(lambda spark, d: TR.split_counts(_tasks(spark, d)))

SPLIT_LIMITS = {"train": 12, "dev": 6}
register("split_head", f"""
SELECT task_id, split, rank FROM (
  SELECT task_id, split, row_number() OVER (PARTITION BY split ORDER BY task_id) AS rank
  FROM ({TASKS_SQL}) t WHERE split IN ('train', 'dev')) x
WHERE rank <= CASE split WHEN 'train' THEN 12 ELSE 6 END
""")(lambda spark, d: TR.split_head(_tasks(spark, d), SPLIT_LIMITS, "task_id").select("task_id", "split", "rank"))

register("split_whole", f"""
SELECT task_id, split, row_number() OVER (PARTITION BY split ORDER BY task_id) AS rank FROM ({TASKS_SQL}) t WHERE split = 'train'
UNION ALL SELECT * FROM (SELECT task_id, split, row_number() OVER (PARTITION BY split ORDER BY task_id) AS rank FROM ({TASKS_SQL}) t
                         WHERE split = 'dev') x WHERE rank <= 6
""")(lambda spark, d: TR.split_head(_tasks(spark, d), {"train": None, "dev": 6}, "task_id").select("task_id", "split", "rank"))

REFRESH_SINCE = "2001-06-01"
register("graph_refresh", f"""
SELECT 'shippedLine' AS rel_type, CAST(l_suppkey AS VARCHAR) AS src_key, {LINE_KEY_SQL} AS dst_key FROM lineitem
WHERE l_shipdate >= TIMESTAMP '{REFRESH_SINCE}' AND l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL
  AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL
UNION ALL
SELECT 'ofPart', {LINE_KEY_SQL}, CAST(l_partkey AS VARCHAR) FROM lineitem
WHERE l_shipdate >= TIMESTAMP '{REFRESH_SINCE}' AND l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL
  AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL
""")(lambda spark, d: RF.incremental_edges(Catalog(spark, d), driver_ontology(), ["shippedLine", "ofPart"], "l_shipdate",
                                            REFRESH_SINCE))

def _changed_orders(spark, d):
    """A feed over all orders in four batches: the orders as they are, every seventh moved to another customer,
    every eleventh cancelled, and the second batch once more with the first versions of cancelled orders late."""
    from pyspark.sql import types as T

    from quarry.session import ensure_checkpoint_dir

    orders = Catalog(spark, d).orders
    first = orders.withColumn("version", F.lit(1)).withColumn("deleted", F.lit(False))
    moved = first.where("o_orderkey % 7 = 0").withColumns({"o_custkey": F.col("o_custkey") % 10 + 1, "version": F.lit(2)})
    gone = first.where("o_orderkey % 11 = 0").withColumns({"version": F.lit(3), "deleted": F.lit(True)})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in first.schema.fields])
    store = RF.FactStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/orders-{uuid.uuid4().hex}", schema, ["o_orderkey"], buckets=16)
    for batch in (first, moved, gone, moved.unionByName(first.where("o_orderkey % 11 = 0"))):
        store.merge(batch)
    return store.edges(driver_ontology(), ["placedOrder"])


register("graph_refresh_changes", """
SELECT 'placedOrder' AS rel_type, CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 10 + 1 ELSE o_custkey END AS VARCHAR) AS src_key,
       CAST(o_orderkey AS VARCHAR) AS dst_key
FROM orders WHERE o_orderkey % 11 <> 0 AND o_custkey IS NOT NULL
""")(_changed_orders)

register("traverse_two_branch", """
WITH best AS (
  SELECT o.o_custkey, l.l_extendedprice, l.l_partkey,
         row_number() OVER (PARTITION BY o.o_custkey ORDER BY l.l_extendedprice DESC, l.l_orderkey, l.l_linenumber,
                            l.l_partkey, l.l_suppkey, l.l_shipdate) AS rn
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
ob AS (SELECT o_custkey, COUNT(*) AS n_orders, SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS n_open_orders
       FROM orders GROUP BY o_custkey)
SELECT c.c_name AS customer_name, p.p_name AS top_part_name, b.l_extendedprice AS top_price, ob.n_orders,
       CAST(ob.n_open_orders AS BIGINT) AS n_open_orders
FROM customer c JOIN ob ON c.c_custkey = ob.o_custkey
LEFT JOIN best b ON b.o_custkey = c.c_custkey AND b.rn = 1 LEFT JOIN part p ON p.p_partkey = b.l_partkey
""")(lambda spark, d: G.two_branch(Catalog(spark, d)))


register("traverse_two_branch_top", """
WITH best AS (
  SELECT o.o_custkey, l.l_extendedprice, l.l_partkey,
         row_number() OVER (PARTITION BY o.o_custkey ORDER BY l.l_extendedprice DESC, l.l_orderkey, l.l_linenumber,
                            l.l_partkey, l.l_suppkey, l.l_shipdate) AS rn
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT c.c_name AS customer_name, p.p_name AS top_part_name, b.l_extendedprice AS top_price, t.rank, t.o_orderkey AS order_id,
       t.o_orderstatus AS status, t.o_totalprice AS total_price
FROM t JOIN customer c ON c.c_custkey = t.o_custkey LEFT JOIN best b ON b.o_custkey = c.c_custkey AND b.rn = 1
LEFT JOIN part p ON p.p_partkey = b.l_partkey WHERE t.rank <= 3
""")(lambda spark, d: G.two_branch_top(Catalog(spark, d)))


@register("dangling_edges", f"""
SELECT 'shippedLine' AS rel_type, CAST(l_suppkey AS VARCHAR) AS src_key, {LINE_KEY_SQL} AS dst_key FROM lineitem
WHERE l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL
  AND l_shipdate IS NOT NULL
  AND CAST(l_suppkey AS VARCHAR) NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal >= 0)
""")
def _dangling_edges(spark, d):
    from dataclasses import replace
    onto = driver_ontology()
    cat = Catalog(spark, d)
    active = replace(onto.entity("Supplier"), where="account_balance >= 0")
    nodes = G.node_table_keys(cat, active)
    edges = G.edge_table(cat, onto, onto.relationship("shippedLine"))
    return G.dangling_edges(edges, nodes, end="src_key")
