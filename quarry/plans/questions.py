"""Question templates (C1-C12) over the semantic layer, and the 42 question analogues.

Each template returns the answer rows of one question as a DataFrame with a single column
``answer`` (scalar questions: at most one row; set questions: one row per member).
Templates are written against entity views, so the plans read only the bound columns they use.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.bindings import Ontology, driver_ontology, entity_view


class Semantic:
    """Catalog + ontology: entity views by name."""

    def __init__(self, catalog, onto: Ontology | None = None):
        self.catalog = catalog
        self.onto = onto or driver_ontology()
        self.spark = catalog.spark

    def view(self, entity: str) -> DataFrame:
        return entity_view(self.catalog, self.onto.entity(entity))


# --- C1-C12 templates -----------------------------------------------------------------------------

def count_where(sem: Semantic, entity: str, where: str | None = None) -> DataFrame:
    """Filter + COUNT(*)."""
    v = sem.view(entity)
    if where:
        v = v.where(where)
    return v.agg(F.count(F.lit(1)).alias("answer"))


def count_distinct(sem: Semantic, entity: str, prop: str) -> DataFrame:
    """COUNT(DISTINCT prop) (exact)."""
    return sem.view(entity).agg(F.count_distinct(prop).alias("answer"))


def distinct_values(sem: Semantic, entity: str, prop: str) -> DataFrame:
    """SELECT DISTINCT prop."""
    return sem.view(entity).select(F.col(prop).alias("answer")).distinct()


def top1_group(sem: Semantic, frame: DataFrame, prop: str) -> DataFrame:
    """C4: most frequent value, ties broken by the value (ascending)."""
    return (frame.groupBy(prop).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.col("_n").desc(), F.col(prop).asc_nulls_last()).limit(1)
            .select(F.col(prop).alias("answer")))


def round_agg(sem: Semantic, frame: DataFrame, prop: str, fn: str) -> DataFrame:
    """ROUND(AVG|MAX(prop), 2)."""
    agg = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[fn]
    return frame.agg(F.round(agg(prop), 2).alias("answer"))


def lines_parts(sem: Semantic, part_where: str | None = None, line_where: str | None = None) -> DataFrame:
    lines = sem.view("LineItem").select("supplier_id", "part_id", "extended_price", "return_flag", "order_id",
                                        "line_number", "ship_date")
    if line_where:
        lines = lines.where(line_where)
    parts = sem.view("Part")
    if part_where:
        parts = parts.where(part_where)
    return lines.join(parts.select("part_id", "part_name", "brand", "part_type", "size"), "part_id")


def suppliers_with_lines(sem: Semantic, part_where: str | None, line_where: str | None = None) -> DataFrame:
    """Supplier -shippedLine-> LineItem -ofPart-> Part with filters; distinct supplier names.

    Expressed as a semi join: suppliers are kept once, so no DISTINCT over joined rows is needed.
    """
    lp = lines_parts(sem, part_where, line_where).select("supplier_id")
    return (sem.view("Supplier").join(lp, "supplier_id", "left_semi")
            .select(F.col("supplier_name").alias("answer")).distinct())


def parts_of_nation_suppliers(sem: Semantic, nation_id: int) -> DataFrame:
    """C7 reversed: distinct part keys on lines of suppliers in one nation."""
    sup = sem.view("Supplier").where(F.col("nation_id") == nation_id).select("supplier_id")
    return (sem.view("LineItem").select("supplier_id", "part_id").join(sup, "supplier_id", "left_semi")
            .select(F.col("part_id").alias("answer")).distinct())


def order_values_of_customer(sem: Semantic, customer_name: str, prop: str) -> DataFrame:
    """Customer -placedOrder-> Order for one named customer; distinct order property."""
    cust = sem.view("Customer").where(F.col("customer_name") == customer_name).select("customer_id")
    return (sem.view("Order").join(cust, "customer_id", "left_semi")
            .select(F.col(prop).alias("answer")).distinct())


def order_values_of_nation(sem: Semantic, nation_name: str, prop: str) -> DataFrame:
    """C8 with a group filter: Nation <- Customer -> Order."""
    nat = sem.view("Nation").where(F.col("nation_name") == nation_name).select("nation_id")
    cust = sem.view("Customer").join(nat, "nation_id", "left_semi").select("customer_id")
    return (sem.view("Order").join(cust, "customer_id", "left_semi")
            .select(F.col(prop).alias("answer")).distinct())


def count_lines_of_supplier(sem: Semantic, supplier_name: str) -> DataFrame:
    """Join + dim filter + COUNT(*)."""
    sup = sem.view("Supplier").where(F.col("supplier_name") == supplier_name).select("supplier_id")
    return sem.view("LineItem").select("supplier_id").join(sup, "supplier_id").agg(
        F.count(F.lit(1)).alias("answer"))


def count_orders_of_customer(sem: Semantic, customer_name: str) -> DataFrame:
    cust = sem.view("Customer").where(F.col("customer_name") == customer_name).select("customer_id")
    return sem.view("Order").select("customer_id").join(cust, "customer_id").agg(
        F.count(F.lit(1)).alias("answer"))


def avg_price_of_part_name(sem: Semantic, part_name: str) -> DataFrame:
    """Join + dim filter + ROUND(AVG, 2)."""
    return round_agg(sem, lines_parts(sem, f"part_name = '{part_name}'"), "extended_price", "avg")


def top_orders_customers(sem: Semantic, k: int = 5) -> DataFrame:
    """Customers of the k largest orders (ties broken by order key): TakeOrderedAndProject."""
    orders = sem.view("Order").select("order_id", "customer_id", "total_price")
    top = orders.orderBy(F.col("total_price").desc(), F.col("order_id").asc()).limit(k)
    return top.join(sem.view("Customer").select("customer_id", "customer_name"), "customer_id").select(
        F.col("customer_name").alias("answer"))


def top_lines_suppliers(sem: Semantic, k: int = 5) -> DataFrame:
    """C6 on lines: suppliers of the k largest lines by extended price (tiebreak: line key)."""
    lines = sem.view("LineItem").select("supplier_id", "extended_price", "order_id", "line_number", "part_id",
                                        "ship_date")
    top = lines.orderBy(F.col("extended_price").desc(), "order_id", "line_number", "part_id", "supplier_id",
                        "ship_date").limit(k)
    return top.join(sem.view("Supplier").select("supplier_id", "supplier_name"), "supplier_id").select(
        F.col("supplier_name").alias("answer"))


def customers_semi_intersection(sem: Semantic, status: str, min_total: float) -> DataFrame:
    """C11: two IN-subqueries (intersection of two relationship sets).

    Both memberships come from one grouped pass over orders (a flag per condition, partial
    aggregation), instead of two scans feeding two semi joins; one semi join keeps the customers.
    """
    flags = (sem.view("Order").groupBy("customer_id")
             .agg(F.max((F.col("status") == status).cast("int")).alias("_a"),
                  F.max((F.col("total_price") > min_total).cast("int")).alias("_b"))
             .where((F.col("_a") == 1) & (F.col("_b") == 1)).select("customer_id"))
    return (sem.view("Customer").join(flags, "customer_id", "left_semi")
            .select(F.col("customer_name").alias("answer")).distinct())


# --- the question set (analogues of the 24 held-out and 18 train/dev questions) ------------------

@dataclass(frozen=True)
class Question:
    id: str
    category: str               # single_hop | multi_hop | negative
    answer_type: str            # scalar | set | refusal
    build: Callable[[Semantic], DataFrame] | None
    split: str | None = None
    traversal: tuple[str, ...] = field(default_factory=tuple)


def _refusal(qid: str, split: str | None = None) -> Question:
    return Question(qid, "negative", "refusal", None, split)


QUESTIONS: list[Question] = [
    Question("S01", "single_hop", "scalar", lambda s: count_where(s, "Order", "status = 'F'"), None, ("Order",)),
    Question("S02", "single_hop", "scalar", lambda s: count_distinct(s, "Customer", "segment"), None, ("Customer",)),
    Question("S03", "single_hop", "set", lambda s: distinct_values(s, "Order", "priority"), None, ("Order",)),
    Question("S04", "single_hop", "scalar", lambda s: count_where(s, "Part", "part_type = 'PROMO'"), None, ("Part",)),
    Question("S05", "single_hop", "scalar", lambda s: top1_group(s, s.view("Part"), "part_type"), None, ("Part",)),
    Question("S06", "single_hop", "scalar", lambda s: round_agg(s, s.view("LineItem"), "extended_price", "avg"),
             None, ("LineItem",)),
    Question("S07", "single_hop", "scalar", lambda s: round_agg(s, s.view("LineItem"), "extended_price", "max"),
             None, ("LineItem",)),
    Question("S08", "single_hop", "scalar", lambda s: count_distinct(s, "LineItem", "return_flag"), None,
             ("LineItem",)),
    Question("M01", "multi_hop", "set", lambda s: top_orders_customers(s, 5), None,
             ("Customer", "placedOrder", "Order")),
    Question("M02", "multi_hop", "set", lambda s: suppliers_with_lines(s, "part_type = 'PROMO' AND size = 1"), None,
             ("Supplier", "shippedLine", "LineItem", "ofPart", "Part")),
    Question("M03", "multi_hop", "set", lambda s: order_values_of_customer(s, "Customer#000000007", "priority"),
             None, ("Customer", "placedOrder", "Order")),
    Question("M04", "multi_hop", "set",
             lambda s: suppliers_with_lines(s, "brand = 'Brand#2' AND size <= 2", "return_flag = 'R'"), None,
             ("Supplier", "shippedLine", "LineItem", "ofPart", "Part")),
    Question("M05", "multi_hop", "scalar", lambda s: count_lines_of_supplier(s, "Supplier#000000003"), None,
             ("Supplier", "shippedLine", "LineItem")),
    Question("M06", "multi_hop", "set", lambda s: parts_of_nation_suppliers(s, 3), None,
             ("Supplier", "shippedLine", "LineItem", "ofPart", "Part")),
    Question("M07", "multi_hop", "set", lambda s: order_values_of_nation(s, "NATION_3", "priority"), None,
             ("Nation", "customerNation", "Customer", "placedOrder", "Order")),
    Question("M08", "multi_hop", "scalar", lambda s: avg_price_of_part_name(s, "small ring"), None,
             ("LineItem", "ofPart", "Part")),
    Question("M09", "multi_hop", "scalar", lambda s: top1_group(s, lines_parts(s), "part_name"), None,
             ("LineItem", "ofPart", "Part")),
    Question("M10", "multi_hop", "set", lambda s: customers_semi_intersection(s, "F", 490000.0), None,
             ("Customer", "placedOrder", "Order")),
    _refusal("N01"), _refusal("N02"), _refusal("N03"), _refusal("N04"), _refusal("N05"), _refusal("N06"),
    Question("T-S01", "single_hop", "scalar", lambda s: count_where(s, "Supplier", "nation_id = 8"), "train",
             ("Supplier",)),
    Question("T-S02", "single_hop", "scalar", lambda s: count_where(s, "Customer", "segment = 'BUILDING'"),
             "train", ("Customer",)),
    Question("T-S03", "single_hop", "set", lambda s: distinct_values(s, "Part", "part_type"), "train", ("Part",)),
    Question("T-S04", "single_hop", "scalar", lambda s: count_where(s, "Part", "brand = 'Brand#7'"), "train",
             ("Part",)),
    Question("T-S05", "single_hop", "scalar", lambda s: round_agg(s, s.view("LineItem"), "discount", "avg"), "dev",
             ("LineItem",)),
    Question("T-S06", "single_hop", "scalar", lambda s: round_agg(s, s.view("Order"), "total_price", "max"), "dev",
             ("Order",)),
    Question("T-M01", "multi_hop", "set", lambda s: top_lines_suppliers(s, 5), "train",
             ("Supplier", "shippedLine", "LineItem")),
    Question("T-M02", "multi_hop", "set", lambda s: suppliers_with_lines(s, "brand = 'Brand#5' AND size <= 3"),
             "train", ("Supplier", "shippedLine", "LineItem", "ofPart", "Part")),
    Question("T-M03", "multi_hop", "set", lambda s: order_values_of_customer(s, "Customer#000000010", "status"),
             "train", ("Customer", "placedOrder", "Order")),
    Question("T-M04", "multi_hop", "set", lambda s: parts_of_nation_suppliers(s, 8), "train",
             ("Supplier", "shippedLine", "LineItem", "ofPart", "Part")),
    Question("T-M05", "multi_hop", "scalar", lambda s: count_orders_of_customer(s, "Customer#000000010"), "train",
             ("Customer", "placedOrder", "Order")),
    Question("T-M06", "multi_hop", "set", lambda s: order_values_of_nation(s, "NATION_5", "priority"), "dev",
             ("Nation", "customerNation", "Customer", "placedOrder", "Order")),
    Question("T-M07", "multi_hop", "scalar", lambda s: avg_price_of_part_name(s, "red widget"), "dev",
             ("LineItem", "ofPart", "Part")),
    Question("T-M08", "multi_hop", "set", lambda s: suppliers_with_lines(s, "part_type = 'SMALL' AND size = 1"),
             "dev", ("Supplier", "shippedLine", "LineItem", "ofPart", "Part")),
    _refusal("T-N01", "train"), _refusal("T-N02", "train"), _refusal("T-N03", "train"), _refusal("T-N04", "dev"),
]

QUESTION_BY_ID = {q.id: q for q in QUESTIONS}


def question_frame(spark, questions: list[Question] | None = None) -> DataFrame:
    """Question metadata as a (small, fixed) DataFrame."""
    qs = questions or QUESTIONS
    rows = [(q.id, q.category, q.answer_type, q.split, list(q.traversal)) for q in qs]
    return spark.createDataFrame(rows, "id string, category string, answer_type string, split string, "
                                       "expected_traversal array<string>")


# --- C12: negatives over the data ----------------------------------------------------------------
# Each negative names something the data may not hold; the answer is a refusal when the lookup is
# empty. The probe of each negative question (entity, property, looked-up value).
NEGATIVE_PROBES = [
    ("N01", "Supplier", "supplier_name", "Supplier#999999999"),
    ("N02", "Customer", "customer_name", "Customer#999999999"),
    ("N03", "Part", "part_name", "golden widget"),
    ("N04", "Nation", "nation_name", "ATLANTIS"),
    ("N05", "Customer", "segment", "SPACE"),
    ("T-N01", "Part", "brand", "Brand#999"),
    ("T-N02", "Order", "priority", "0-NEVER"),
    ("T-N03", "Part", "part_type", "IMAGINARY"),
]


def unanswerable(sem: Semantic) -> DataFrame:
    """Question table LEFT JOIN the lookup of each probed value -> refusal when nothing matches.

    Output: ``(id, probe_value, n_matches, answer_type)``.
    """
    from functools import reduce

    probes = sem.spark.createDataFrame([(i, e, p, v) for i, e, p, v in NEGATIVE_PROBES],
                                       "id string, entity string, prop string, probe_value string")
    asked: dict[tuple[str, str], list[str]] = {}
    for _, ent, prop, value in NEGATIVE_PROBES:
        asked.setdefault((ent, prop), []).append(value)
    # the looked-up values reach the scan of their table as a filter
    counts = reduce(DataFrame.unionByName, [
        sem.view(e).where(F.col(p).isin(values)).groupBy(F.col(p).cast("string").alias("probe_value"))
        .agg(F.count(F.lit(1)).alias("n")).withColumns({"entity": F.lit(e), "prop": F.lit(p)})
        for (e, p), values in asked.items()])
    out = probes.join(counts, ["entity", "prop", "probe_value"], "left").select(
        "id", "probe_value", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_matches"))
    return out.withColumn("answer_type", F.when(F.col("n_matches") == 0, "refusal").otherwise("scalar"))


#: fixed values: the questions that name an entity which may not exist
UNKNOWN_ENTITIES = [("N06", "Supplier#999999999"), ("T-N04", "Supplier#888888888")]


def unknown_entity_lines(sem: Semantic, asked: list[tuple[str, str]] | None = None) -> DataFrame:
    """C12 (N06 and T-N04 shape): lines of named suppliers; an unknown name keeps one explicit no-rows row."""
    asked = asked or UNKNOWN_ENTITIES
    q = sem.spark.createDataFrame(asked, "id string, supplier_name string")
    names = [name for _, name in asked]
    sup = sem.view("Supplier").where(F.col("supplier_name").isin(names)).select("supplier_id", "supplier_name")
    per = (sem.view("LineItem").select("supplier_id").join(sup, "supplier_id")
           .groupBy("supplier_name").agg(F.count(F.lit(1)).alias("n_lines")))
    return q.join(per, "supplier_name", "left").select(
        "id", "supplier_name", F.col("n_lines"),
        F.when(F.col("n_lines").isNull(), "no rows").otherwise("rows").alias("status"))
