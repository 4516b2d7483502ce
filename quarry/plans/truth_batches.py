"""The question analogues grouped by what they read (see ``plans.batch``).

Table-wide questions read their table without any join. Selective ones join the fact table with the
dimension rows that some question names: the filters reach the dimension's scan, the filtered side
is small and AQE broadcasts it by its run-time size, so the fact table isn't shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.batch import BatchQuestion as BQ
from quarry.plans.batch import evaluate
from quarry.plans.questions import Semantic

c = F.col


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def line_questions() -> list[BQ]:
    return [
        BQ("S06", "avg", value=c("extended_price")),
        BQ("S07", "max", value=c("extended_price")),
        BQ("S08", "count_distinct", member=c("return_flag")),
        BQ("T-S05", "avg", value=c("discount")),
    ]


def part_line_questions() -> list[tuple[BQ, Column]]:
    """Questions on the lines of some parts, each with its condition on the part alone."""
    promo = (c("part_type") == "PROMO") & (c("size") == 1)
    second = (c("brand") == "Brand#2") & (c("size") <= 2)
    ring, widget = c("part_name") == "small ring", c("part_name") == "red widget"
    fifth = (c("brand") == "Brand#5") & (c("size") <= 3)
    small = (c("part_type") == "SMALL") & (c("size") == 1)
    return [
        (BQ("M02", "set", promo, member=c("supplier_id")), promo),
        (BQ("M04", "set", (c("return_flag") == "R") & second, member=c("supplier_id")), second),
        (BQ("M08", "avg", ring, value=c("extended_price")), ring),
        (BQ("T-M02", "set", fifth, member=c("supplier_id")), fifth),
        (BQ("T-M07", "avg", widget, value=c("extended_price")), widget),
        (BQ("T-M08", "set", small, member=c("supplier_id")), small),
    ]


def part_lines(sem: Semantic, wanted: set[str]) -> tuple[DataFrame | None, set[str]]:
    chosen = [(q, cond) for q, cond in part_line_questions() if q.qid in wanted]
    if not chosen:
        return None, set()
    part = sem.view("Part").where(_any([cond for _, cond in chosen])).select(
        c("part_id").alias("p_id"), "part_name", "brand", "part_type", "size")
    lines = sem.view("LineItem").select("supplier_id", "part_id", "extended_price", "return_flag")
    rows = evaluate(lines.join(part, c("part_id") == c("p_id")), [q for q, _ in chosen])
    # sets hold supplier ids so far: one name a distinct id
    sets = [q.qid for q, _ in chosen if q.reducer == "set"]
    names = sem.view("Supplier").select(c("supplier_id").cast("string").alias("value_text"), "supplier_name")
    named = (rows.where(c("id").isin(sets)).join(names, "value_text")
             .select("id", c("supplier_name").alias("value_text"), "value_num").distinct())
    return rows.where(~c("id").isin(sets)).unionByName(named), {q.qid for q, _ in chosen}


def supplier_line_questions() -> list[tuple[BQ, Column]]:
    third, eighth, named = c("nation_id") == 3, c("nation_id") == 8, c("supplier_name") == "Supplier#000000003"
    return [
        (BQ("M05", "count", named), named),
        (BQ("M06", "set", third, member=c("part_id")), third),
        (BQ("T-M04", "set", eighth, member=c("part_id")), eighth),
    ]


def supplier_lines(sem: Semantic, wanted: set[str]) -> tuple[DataFrame | None, set[str]]:
    chosen = [(q, cond) for q, cond in supplier_line_questions() if q.qid in wanted]
    if not chosen:
        return None, set()
    some = sem.view("Supplier").where(_any([cond for _, cond in chosen])).select(
        c("supplier_id").alias("s_id"), "supplier_name", "nation_id")
    lines = sem.view("LineItem").select("supplier_id", "part_id")
    return evaluate(lines.join(some, c("supplier_id") == c("s_id")), [q for q, _ in chosen]), {q.qid for q, _ in chosen}


def commonest_part(sem: Semantic, wanted: set[str]) -> tuple[DataFrame | None, set[str]]:
    """Lines are counted per part before the names are joined."""
    if "M09" not in wanted:
        return None, set()
    per = sem.view("LineItem").groupBy("part_id").agg(F.count(F.lit(1)).alias("n"))
    named = per.join(sem.view("Part").select("part_id", "part_name"), "part_id").groupBy("part_name").agg(F.sum("n").alias("n"))
    best = named.agg(F.min(F.struct((-c("n")).alias("neg"), c("part_name").isNull().alias("none"), "part_name")).alias("best"))
    return best.where("best IS NOT NULL").select(F.lit("M09").alias("id"), c("best.part_name").alias("value_text"),
                                                 F.lit(None).cast("double").alias("value_num")), {"M09"}


def order_questions() -> list[BQ]:
    return [
        BQ("S01", "count", c("status") == "F"),
        BQ("S03", "set", member=c("priority")),
        BQ("T-S06", "max", value=c("total_price")),
    ]


def customer_order_questions() -> list[tuple[BQ, Column]]:
    seven, ten = c("customer_name") == "Customer#000000007", c("customer_name") == "Customer#000000010"
    third, fifth = c("nation_name") == "NATION_3", c("nation_name") == "NATION_5"
    return [
        (BQ("M03", "set", seven, member=c("priority")), seven),
        (BQ("M07", "set", third, member=c("priority")), third),
        (BQ("T-M03", "set", ten, member=c("status")), ten),
        (BQ("T-M05", "count", ten), ten),
        (BQ("T-M06", "set", fifth, member=c("priority")), fifth),
    ]


def customer_orders(sem: Semantic, wanted: set[str]) -> tuple[DataFrame | None, set[str]]:
    chosen = [(q, cond) for q, cond in customer_order_questions() if q.qid in wanted]
    if not chosen:
        return None, set()
    nation = sem.view("Nation").select(c("nation_id").alias("n_id"), "nation_name")
    some = (sem.view("Customer").select(c("customer_id").alias("c_id"), "customer_name", "nation_id")
            .join(nation, c("nation_id") == c("n_id"), "left").where(_any([cond for _, cond in chosen])))
    orders = sem.view("Order").select("customer_id", "status", "priority")
    return evaluate(orders.join(some, c("customer_id") == c("c_id")), [q for q, _ in chosen]), {q.qid for q, _ in chosen}


def part_questions() -> list[BQ]:
    return [
    BQ("S04", "count", c("part_type") == "PROMO"),
    BQ("S05", "top1", member=c("part_type")),
    BQ("T-S03", "set", member=c("part_type")),
    BQ("T-S04", "count", c("brand") == "Brand#7"),
]

def customer_questions() -> list[BQ]:
    return [
    BQ("S02", "count_distinct", member=c("segment")),
    BQ("T-S02", "count", c("segment") == "BUILDING"),
]

def supplier_questions() -> list[BQ]:
    return [BQ("T-S01", "count", c("nation_id") == 8)]


def batched_truth(sem: Semantic, wanted: set[str]) -> tuple[DataFrame, set[str]]:
    """Truth rows of the batchable questions among ``wanted``; returns (rows, ids covered)."""
    whole = {"LineItem": line_questions, "Order": order_questions, "Part": part_questions,
             "Customer": customer_questions, "Supplier": supplier_questions}
    parts, done = [], set()
    for entity, qs in whole.items():
        sel = [q for q in qs() if q.qid in wanted]
        if sel:
            parts.append(evaluate(sem.view(entity), sel))
            done |= {q.qid for q in sel}
    for group in (part_lines, supplier_lines, commonest_part, customer_orders):
        rows, ids = group(sem, wanted)
        if rows is not None:
            parts.append(rows)
            done |= ids
    return (reduce(DataFrame.unionByName, parts) if parts else None), done
