"""Semantic layer (B1, B2): entity types bound to table columns, typed directed relationships.

The spec is a tiny driver-side description; every view it yields is a lazy ``select`` over
the bound table, so column pruning and filter pushdown reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Value types of the binding language -> Spark types (unknown types fall back to STRING).
VALUE_TYPES: dict[str, T.DataType] = {
    "String": T.StringType(),
    "Double": T.DoubleType(),
    "BigInt": T.LongType(),
    "Int": T.IntegerType(),
    "Boolean": T.BooleanType(),
    "DateTime": T.TimestampType(),
    "Date": T.DateType(),
}


def spark_type(value_type: str) -> T.DataType:
    return VALUE_TYPES.get(value_type, T.StringType())


@dataclass(frozen=True)
class Property:
    name: str
    source: str
    value_type: str = "String"


@dataclass(frozen=True)
class EntityType:
    name: str
    table: str
    key: tuple[str, ...]          # property names forming the key
    display: str                  # property used as the node label
    properties: tuple[Property, ...]
    where: str | None = None      # optional row filter of the binding (SQL on property names)

    def prop(self, name: str) -> Property:
        for p in self.properties:
            if p.name == name:
                return p
        raise KeyError(f"{self.name} has no property {name}")


@dataclass(frozen=True)
class RelationshipType:
    name: str
    source: str                   # entity name
    target: str                   # entity name
    table: str                    # fact table holding both ends
    source_cols: tuple[str, ...]  # columns of ``table`` that form the source key
    target_cols: tuple[str, ...]  # columns of ``table`` that form the target key


@dataclass
class Ontology:
    entities: dict[str, EntityType] = field(default_factory=dict)
    relationships: dict[str, RelationshipType] = field(default_factory=dict)

    def entity(self, name: str) -> EntityType:
        return self.entities[name]

    def relationship(self, name: str) -> RelationshipType:
        return self.relationships[name]

    def source_tables(self) -> list[str]:
        """Each base table once, in first-use order (entities first, then fact tables)."""
        seen: dict[str, None] = {}
        for e in self.entities.values():
            seen.setdefault(e.table, None)
        for r in self.relationships.values():
            seen.setdefault(r.table, None)
        return list(seen)


def parse_ontology(spec: dict[str, Any]) -> Ontology:
    """B1: a JSON-like spec -> Ontology. Relationship ends must name declared entities."""
    onto = Ontology()
    for e in spec.get("entities", []):
        props = tuple(Property(p["name"], p.get("source", p["name"]), p.get("type", "String"))
                      for p in e["properties"])
        onto.entities[e["name"]] = EntityType(e["name"], e["table"], tuple(e["key"]), e["display"], props,
                                              e.get("where"))
    for r in spec.get("relationships", []):
        for end in (r["source"], r["target"]):
            if end not in onto.entities:
                raise ValueError(f"relationship {r['name']} names unknown entity {end}")
        onto.relationships[r["name"]] = RelationshipType(
            r["name"], r["source"], r["target"], r["table"], tuple(r["source_cols"]), tuple(r["target_cols"]))
    return onto


def key_column(cols: list[Column] | tuple[Column, ...]) -> Column:
    """Uniform STRING node key: single column cast to text, composite keys joined with ':'."""
    if len(cols) == 1:
        return cols[0].cast("string")
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def source_expr(source: str, value_type: str) -> Column:
    """Typed source column. DateTime sources are read as TIMESTAMP; dates keep day precision."""
    c = F.col(source)
    if value_type == "Date":
        return c.cast("date")
    return c.cast(spark_type(value_type))


def entity_view(catalog, entity: EntityType) -> DataFrame:
    """B2: typed projection of the bound columns, renamed to property names."""
    df = catalog.table(entity.table)
    view = df.select(*[source_expr(p.source, p.value_type).alias(p.name) for p in entity.properties])
    # The binding's row filter is written on property names; Catalyst pushes it into the scan.
    return view.where(entity.where) if entity.where else view


def entity_key(entity: EntityType) -> Column:
    return key_column([F.col(k) for k in entity.key])


# --- the binding of the driver tables -------------------------------------------------------------
# Site ~ supplier / customer, measurement ~ lineitem, species ~ part, treatment ~ orders.

DRIVER_SPEC: dict[str, Any] = {
    "entities": [
        {"name": "Customer", "table": "customer", "key": ["customer_id"], "display": "customer_name",
         "properties": [
             {"name": "customer_id", "source": "c_custkey", "type": "BigInt"},
             {"name": "customer_name", "source": "c_name"},
             {"name": "nation_id", "source": "c_nationkey", "type": "Int"},
             {"name": "account_balance", "source": "c_acctbal", "type": "Double"},
             {"name": "segment", "source": "c_mktsegment"}]},
        {"name": "Supplier", "table": "supplier", "key": ["supplier_id"], "display": "supplier_name",
         "properties": [
             {"name": "supplier_id", "source": "s_suppkey", "type": "BigInt"},
             {"name": "supplier_name", "source": "s_name"},
             {"name": "nation_id", "source": "s_nationkey", "type": "Int"},
             {"name": "account_balance", "source": "s_acctbal", "type": "Double"}]},
        {"name": "Nation", "table": "nation", "key": ["nation_id"], "display": "nation_name",
         "properties": [
             {"name": "nation_id", "source": "n_nationkey", "type": "Int"},
             {"name": "nation_name", "source": "n_name"},
             {"name": "region_id", "source": "n_regionkey", "type": "Int"}]},
        {"name": "Part", "table": "part", "key": ["part_id"], "display": "part_name",
         "properties": [
             {"name": "part_id", "source": "p_partkey", "type": "BigInt"},
             {"name": "part_name", "source": "p_name"},
             {"name": "brand", "source": "p_brand"},
             {"name": "part_type", "source": "p_type"},
             {"name": "size", "source": "p_size", "type": "Int"},
             {"name": "retail_price", "source": "p_retailprice", "type": "Double"}]},
        {"name": "Order", "table": "orders", "key": ["order_id"], "display": "order_id",
         "properties": [
             {"name": "order_id", "source": "o_orderkey", "type": "BigInt"},
             {"name": "customer_id", "source": "o_custkey", "type": "BigInt"},
             {"name": "status", "source": "o_orderstatus"},
             {"name": "total_price", "source": "o_totalprice", "type": "Double"},
             {"name": "order_date", "source": "o_orderdate", "type": "DateTime"},
             {"name": "priority", "source": "o_orderpriority"}]},
        {"name": "LineItem", "table": "lineitem",
         "key": ["order_id", "line_number", "part_id", "supplier_id", "ship_date"], "display": "line_key",
         "properties": [
             {"name": "order_id", "source": "l_orderkey", "type": "BigInt"},
             {"name": "line_number", "source": "l_linenumber", "type": "Int"},
             {"name": "part_id", "source": "l_partkey", "type": "BigInt"},
             {"name": "supplier_id", "source": "l_suppkey", "type": "BigInt"},
             {"name": "ship_date", "source": "l_shipdate", "type": "Date"},
             {"name": "quantity", "source": "l_quantity", "type": "Double"},
             {"name": "extended_price", "source": "l_extendedprice", "type": "Double"},
             {"name": "discount", "source": "l_discount", "type": "Double"},
             {"name": "return_flag", "source": "l_returnflag"},
             {"name": "line_status", "source": "l_linestatus"}]},
    ],
    "relationships": [
        {"name": "placedOrder", "source": "Customer", "target": "Order", "table": "orders",
         "source_cols": ["o_custkey"], "target_cols": ["o_orderkey"]},
        {"name": "shippedLine", "source": "Supplier", "target": "LineItem", "table": "lineitem",
         "source_cols": ["l_suppkey"],
         "target_cols": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]},
        {"name": "ofPart", "source": "LineItem", "target": "Part", "table": "lineitem",
         "source_cols": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"],
         "target_cols": ["l_partkey"]},
        {"name": "customerNation", "source": "Customer", "target": "Nation", "table": "customer",
         "source_cols": ["c_custkey"], "target_cols": ["c_nationkey"]},
        {"name": "supplierNation", "source": "Supplier", "target": "Nation", "table": "supplier",
         "source_cols": ["s_suppkey"], "target_cols": ["s_nationkey"]},
    ],
}


def driver_ontology() -> Ontology:
    return parse_ontology(DRIVER_SPEC)
