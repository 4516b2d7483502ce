"""Property-graph projection and traversal over the bindings.

Nodes and edges are narrow, map-only projections (no shuffle). Traversal is a chain of
equi-joins straight over the fact table, so Catalyst prunes columns and AQE chooses
broadcast for whichever side turns out small at run time (size-checked by the
``autoBroadcastJoinThreshold``); nothing here hints a broadcast on a table that grows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.order_stats import top_k_per_group
from quarry.plans.bindings import (EntityType, Ontology, RelationshipType, entity_key, entity_view,
                                   key_column, source_expr)


def _end_key(cols: tuple[str, ...], entity: EntityType) -> Column:
    """Key of one relationship end, typed like the entity's key properties (same text as the node key)."""
    typed = [source_expr(c, entity.prop(k).value_type) for c, k in zip(cols, entity.key)]
    return key_column(typed)


def properties_json(entity: EntityType) -> Column:
    """The bound properties of a node as one JSON object of texts, in binding order; NULLs left out.
    One type for all node types, so that they fit one frame."""
    return F.to_json(F.struct(*[F.col(p.name).cast("string").alias(p.name) for p in entity.properties]))


def node_table_keys(catalog, entity: EntityType) -> DataFrame:
    """Keys of one entity's nodes (the binding's row filter applied to the typed view)."""
    view = entity_view(catalog, entity)
    return view.select(entity_key(entity).alias("node_key"))


def graph_nodes(catalog, onto: Ontology, entities: list[str] | None = None) -> DataFrame:
    """All node types in one uniform frame ``(node_type, node_key, node_label, n_props, props)``."""
    parts = []
    for name in entities or list(onto.entities):
        e = onto.entity(name)
        view = entity_view(catalog, e)
        names = [p.name for p in e.properties]
        label = F.col(e.display) if e.display in names else entity_key(e)
        parts.append(view.select(F.lit(e.name).alias("node_type"), entity_key(e).alias("node_key"),
                                 label.cast("string").alias("node_label"),
                                 F.lit(len(e.properties)).alias("n_props"), properties_json(e).alias("props")))
    return reduce(DataFrame.unionByName, parts)


def edge_table(catalog, onto: Ontology, rel: RelationshipType) -> DataFrame:
    """Edges of one relationship, read from its fact table; NULL ends are not edges."""
    src, dst = onto.entity(rel.source), onto.entity(rel.target)
    fact = catalog.table(rel.table)
    cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rel.source_cols + rel.target_cols])
    return fact.where(cond).select(F.lit(rel.name).alias("rel_type"),
                                   _end_key(rel.source_cols, src).alias("src_key"),
                                   _end_key(rel.target_cols, dst).alias("dst_key"))


def edges_from_fact(fact: DataFrame, onto: Ontology, rels: list[RelationshipType]) -> DataFrame:
    """Edges of several relationships held in the same fact table, from one scan of it: each row
    yields one (rel_type, src_key, dst_key) struct per relationship whose ends are present."""
    if len(rels) == 1:
        rel = rels[0]
        src, dst = onto.entity(rel.source), onto.entity(rel.target)
        cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rel.source_cols + rel.target_cols])
        return fact.where(cond).select(F.lit(rel.name).alias("rel_type"),
                                       _end_key(rel.source_cols, src).alias("src_key"),
                                       _end_key(rel.target_cols, dst).alias("dst_key"))
    tags = []
    for rel in rels:
        src, dst = onto.entity(rel.source), onto.entity(rel.target)
        cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rel.source_cols + rel.target_cols])
        tags.append(F.when(cond, F.struct(F.lit(rel.name).alias("rel_type"),
                                          _end_key(rel.source_cols, src).alias("src_key"),
                                          _end_key(rel.target_cols, dst).alias("dst_key"))))
    # plain explode + null filter (stays in generated code)
    return (fact.select(F.explode(F.array(*tags)).alias("e")).where(F.col("e").isNotNull())
            .select("e.rel_type", "e.src_key", "e.dst_key"))


def graph_edges(catalog, onto: Ontology, relationships: list[str] | None = None) -> DataFrame:
    """All edge types in one frame ``(rel_type, src_key, dst_key)``; each fact table is read once."""
    by_table: dict[str, list[RelationshipType]] = {}
    for r in relationships or list(onto.relationships):
        rel = onto.relationship(r)
        by_table.setdefault(rel.table, []).append(rel)
    parts = [edges_from_fact(catalog.table(t), onto, rels) for t, rels in by_table.items()]
    return reduce(DataFrame.unionByName, parts)


def _prop_for_source(entity: EntityType, source: str) -> str:
    for p in entity.properties:
        if p.source == source:
            return p.name
    raise KeyError(f"{entity.name} binds no property to column {source}")


def traverse(catalog, onto: Ontology, path: list[str], where: dict[str, str] | None = None,
             select: dict[str, list[str]] | None = None) -> DataFrame:
    """Follow ``[Entity, rel, Entity, rel, Entity, ...]`` as a chain of equi-joins.

    ``where`` holds a SQL predicate per entity, applied to its view before the join (so it is
    pushed into that scan); ``select`` names the properties returned per entity, as
    ``<entity>_<prop>``. When a relationship lives in the table of one of its two entities
    (the usual case), the hop is a direct key join with that entity's view: the fact table is
    not joined with itself. Only a bridge relationship reads its own table.
    """
    where = where or {}
    select = select or {}
    if len(path) % 2 == 0:
        raise ValueError("path must alternate Entity, rel, Entity, ...")

    def view(name: str) -> DataFrame:
        e = onto.entity(name)
        v = entity_view(catalog, e)
        if name in where:
            v = v.where(where[name])
        return v.select(*[F.col(p.name).alias(f"{name}__{p.name}") for p in e.properties])

    def conj(pairs):
        return reduce(lambda a, b: a & b, [l == r for l, r in pairs])

    current = view(path[0])
    for i in range(1, len(path), 2):
        rel = onto.relationship(path[i])
        prev_name, nxt_name = path[i - 1], path[i + 1]
        if {rel.source, rel.target} != {prev_name, nxt_name}:
            raise ValueError(f"{rel.name} does not connect {prev_name} and {nxt_name}")
        prev_e, nxt_e = onto.entity(prev_name), onto.entity(nxt_name)
        forward = rel.source == prev_name
        prev_cols = rel.source_cols if forward else rel.target_cols
        nxt_cols = rel.target_cols if forward else rel.source_cols
        nv = view(nxt_name)
        if rel.table == nxt_e.table:
            # next entity's rows carry the reference to the previous entity
            cond = conj([(current[f"{prev_name}__{k}"], nv[f"{nxt_name}__{_prop_for_source(nxt_e, c)}"])
                         for c, k in zip(prev_cols, prev_e.key)])
            current = current.join(nv, cond, "inner")
        elif rel.table == prev_e.table:
            # previous entity's rows carry the reference to the next entity
            cond = conj([(current[f"{prev_name}__{_prop_for_source(prev_e, c)}"], nv[f"{nxt_name}__{k}"])
                         for c, k in zip(nxt_cols, nxt_e.key)])
            current = current.join(nv, cond, "inner")
        else:
            fact = catalog.table(rel.table)
            hop = fact.select(*[source_expr(c, prev_e.prop(k).value_type).alias(f"__p{j}")
                                for j, (c, k) in enumerate(zip(prev_cols, prev_e.key))],
                              *[source_expr(c, nxt_e.prop(k).value_type).alias(f"__n{j}")
                                for j, (c, k) in enumerate(zip(nxt_cols, nxt_e.key))])
            cond = conj([(current[f"{prev_name}__{k}"], hop[f"__p{j}"]) for j, k in enumerate(prev_e.key)])
            current = current.join(hop, cond, "inner")
            cond = conj([(current[f"__n{j}"], nv[f"{nxt_name}__{k}"]) for j, k in enumerate(nxt_e.key)])
            current = current.join(nv, cond, "inner").drop(*[c for c in current.columns if c.startswith("__")])
    out = []
    for name in dict.fromkeys(path[0::2]):
        for p in select.get(name, []):
            out.append(F.col(f"{name}__{p}").alias(f"{name.lower()}_{p}"))
    return current.select(*out) if out else current


# --- contracts (B9) -----------------------------------------------------------------------------

#: rows of one task behind the shuffle, and tasks that a hot key is dealt to
TASK_ROWS, HOT_SHARES = 500_000, 16


def summed_by_key(rows: DataFrame, keys: list[str], sums: list[str], n_rows: int, hot: bool = False) -> DataFrame:
    """``(keys..., sums...)``, the long columns ``sums`` added up by key, in memory that doesn't grow with the
    table. Keys here are mostly unique: a hash table over a task's input would hold them all, so rows are first
    dealt by key to as many tasks as ``n_rows`` asks for. Where keys repeat much (``hot``), a key's rows are
    summed in ``HOT_SHARES`` shares before."""
    n, total = max(1, math.ceil(n_rows / TASK_ROWS)), [F.sum(c).alias(c) for c in sums]
    dealt = rows.select(*keys, *sums)
    if hot:
        dealt = dealt.withColumn("_share", F.monotonically_increasing_id() % HOT_SHARES)
        dealt = dealt.repartition(n, *keys, "_share").groupBy(*keys, "_share").agg(*total)
    return dealt.repartition(n, *keys).groupBy(*keys).agg(*total)


def key_violations(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """Keys that occur more than once: ``(key..., n)``."""
    return summed_by_key(df.withColumn("n", F.lit(1).cast("long")), key_cols, ["n"], df.count()).where(F.col("n") > 1)


def dangling_edges(edges: DataFrame, nodes: DataFrame, end: str = "dst_key") -> DataFrame:
    """Edges whose ``end`` has no node (``left_anti`` on the node key)."""
    return edges.join(nodes.select(F.col("node_key").alias(end)), on=end, how="left_anti")


def entity_key_violations(catalog, onto: Ontology, entities: list[str] | None = None) -> DataFrame:
    """Declared keys that occur more than once or hold a NULL part, for every entity:
    ``(node_type, key_text, n)``."""
    parts = []
    for name in entities or list(onto.entities):
        e = onto.entity(name)
        view = entity_view(catalog, e)
        text = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in e.key])
        missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in e.key])
        counts = summed_by_key(view.select(*e.key, F.lit(1).cast("long").alias("_n")), list(e.key), ["_n"],
                               catalog.table(e.table).count())
        parts.append(counts.where((F.col("_n") > 1) | missing)
                     .select(F.lit(name).alias("node_type"), text.alias("key_text"), F.col("_n").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def dangling_ends(catalog, onto: Ontology, relationships: list[str] | None = None) -> DataFrame:
    """Ends of edges that have no node, for both ends of every relationship:
    ``(rel_type, edge_end, missing_key, n_edges)``. Edges and nodes are counted by key together, without a
    join; no task sorts, or holds more than its share of the keys."""
    one, none = (F.lit(k).cast("long") for k in (1, 0))
    parts = []
    for name in relationships or list(onto.relationships):
        rel = onto.relationship(name)
        edges = edge_table(catalog, onto, rel)
        for end, entity in (("src_key", onto.entity(rel.source)), ("dst_key", onto.entity(rel.target))):
            used = edges.select(F.col(end).alias("node_key"), one.alias("n_edges"), none.alias("nodes"))
            nodes = node_table_keys(catalog, entity).where(F.col("node_key").isNotNull())
            both = used.unionByName(nodes.select("node_key", none.alias("n_edges"), one.alias("nodes")))
            n_rows = catalog.table(rel.table).count() + catalog.table(entity.table).count()
            gone = summed_by_key(both, ["node_key"], ["n_edges", "nodes"], n_rows, hot=entity.table != rel.table)
            gone = gone.where(F.col("nodes") == 0)
            parts.append(gone.select(F.lit(name).alias("rel_type"), F.lit(end).alias("edge_end"),
                                     F.col("node_key").alias("missing_key"), "n_edges"))
    return reduce(DataFrame.unionByName, parts)


def two_branch_top(catalog, k: int = 3) -> DataFrame:
    """B8 with its treatment branch listed: per customer and its k dearest orders one row, next to the
    customer's best line: ``(customer_name, top_part_name, top_price, rank, order_id, status, total_price)``."""
    orders = catalog.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    top = top_k_per_group(orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], k, "rank")
    cust = catalog.customer.select("c_custkey", "c_name")
    named = top.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    best = two_branch(catalog, keyed=True)
    return named.join(best, F.col("c_custkey") == F.col("customer_key")).select(
        "customer_name", "top_part_name", "top_price", F.col("rank").cast("long").alias("rank"),
        F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_price"))


def two_branch(catalog, keyed: bool = False) -> DataFrame:
    """Per customer, the top line of its orders (price desc, line key asc) with that line's
    part, next to an order summary of the same customer.

    Lines are reduced to one best line per order *before* the join to orders (map-side
    partial aggregation), then to one per customer; the part name is looked up for the single
    winning line only, and the order branch is a plain grouped count.
    """
    li = catalog.lineitem
    best = F.min(F.struct((-F.col("l_extendedprice")).alias("neg_price"), "l_orderkey", "l_linenumber",
                          "l_partkey", "l_suppkey", "l_shipdate"))
    per_order = li.groupBy("l_orderkey").agg(best.alias("b"))
    o = catalog.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    # one pass over orders feeds both branches: the best line and the order summary per customer
    per_cust = (o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
                .groupBy("o_custkey").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n_orders"),
                                          F.sum((F.col("o_orderstatus") == "O").cast("long")).alias("n_open_orders")))
    part = catalog.part.select("p_partkey", "p_name")
    top = per_cust.join(part, F.col("b.l_partkey") == F.col("p_partkey"), "left")
    cust = catalog.customer.select("c_custkey", "c_name")
    return (cust.join(top, cust.c_custkey == top.o_custkey)
            .select(*([F.col("c_custkey").alias("customer_key")] if keyed else []), F.col("c_name").alias("customer_name"), F.col("p_name").alias("top_part_name"),
                    (-F.col("b.neg_price")).alias("top_price"), "n_orders", "n_open_orders"))
