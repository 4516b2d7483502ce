"""B1 from a folder: many small JSON documents that name each other by id.

Layout: ``EntityTypes/<id>/definition.json`` with ``DataBindings/*.json`` beside it, and
``RelationshipTypes/<id>/definition.json`` with ``Contextualizations/*.json``. Ids are resolved by joins: key parts, label and
bindings to property ids, relationship ends to entity ids, key bindings to the key parts of the end they
belong to. The result is the same ``Ontology`` that ``parse_ontology`` makes from one dict.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.bindings import Ontology, parse_ontology

# The fields that the documents are read for.
ENTITY = ("id string, name string, entityIdParts array<string>, displayNamePropertyId string, "
          "properties array<struct<id: string, name: string, valueType: string>>")
BINDING = ("dataBindingConfiguration struct<propertyBindings: array<struct<sourceColumnName: string, targetPropertyId: string>>, "
           "sourceTableProperties: struct<sourceTableName: string>>")
RELATIONSHIP = "id string, name string, source struct<entityTypeId: string>, target struct<entityTypeId: string>"
CONTEXT = ("dataBindingTable struct<sourceTableName: string>, sourceKeyRefBindings array<struct<sourceColumnName: string, targetPropertyId: string>>, "
           "targetKeyRefBindings array<struct<sourceColumnName: string, targetPropertyId: string>>")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, owner, role, file, body) of every JSON document below ``folder``: kind and owner are the folders
    that hold it, role is ``definition`` or the name of the subfolder."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    steps = F.split(F.col("_metadata.file_path"), "/")
    at = lambda i: F.try_element_at(steps, F.lit(i))
    defined = at(-1) == "definition.json"
    return files.select(F.when(defined, at(-3)).otherwise(at(-4)).alias("kind"), F.when(defined, at(-2)).otherwise(at(-3)).alias("owner"),
                        F.when(defined, F.lit("definition")).otherwise(at(-2)).alias("role"), at(-1).alias("file"), F.col("value").alias("body"))


def _read(docs: DataFrame, kind: str, role: str, schema: str) -> DataFrame:
    """(owner, file, d) of the documents of one kind and role; a document that is no JSON fails."""
    rows = docs.where((F.col("kind") == kind) & (F.col("role") == role))
    return rows.select("owner", "file", F.from_json("body", schema, {"mode": "FAILFAST"}).alias("d"))


def _first(rows: DataFrame) -> DataFrame:
    """One document per owner: the first by file name."""
    return rows.groupBy("owner").agg(F.min_by("d", "file").alias("d"))


def read_ontology(spark: SparkSession, folder: str) -> Ontology:
    """The ontology of a folder. Entities and relationships come in the order of their folders.

    An entity without a binding, an id that nothing defines, a name used twice, or a key that a
    relationship doesn't bind whole is an error that names the entity or relationship.
    """
    docs = documents(spark, folder)
    entity = _read(docs, "EntityTypes", "definition", ENTITY).select("owner", "d.*")
    bound = _first(_read(docs, "EntityTypes", "DataBindings", BINDING)).select(
        "owner", F.col("d.dataBindingConfiguration.sourceTableProperties.sourceTableName").alias("table"),
        F.map_from_entries(F.transform("d.dataBindingConfiguration.propertyBindings", lambda b: F.struct(b["targetPropertyId"], b["sourceColumnName"])))
        .alias("columns"))
    # property ids -> names within the entity
    entity = entity.join(bound, "owner", "left").withColumn("names", F.map_from_entries(F.transform("properties", lambda p: F.struct(p["id"], p["name"]))))
    entity = entity.select(
        "owner", "id", "name", "table", F.transform("entityIdParts", lambda p: F.struct(p.alias("id"), F.try_element_at("names", p).alias("name")))
        .alias("key"), F.try_element_at("names", F.col("displayNamePropertyId")).alias("display"), "displayNamePropertyId",
        F.transform("properties", lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["valueType"].alias("type"),
                                                     F.try_element_at("columns", p["id"]).alias("source"))).alias("properties"))

    ends = entity.select(F.col("id").alias("end"), F.col("name").alias("end_name"), F.transform("key", lambda k: k["id"]).alias("parts"))
    context = _first(_read(docs, "RelationshipTypes", "Contextualizations", CONTEXT)).select("owner", F.col("d").alias("c"))
    rel = _read(docs, "RelationshipTypes", "definition", RELATIONSHIP).select("owner", "d.*").join(context, "owner", "left")
    for end in ("source", "target"):
        named = ends.select(F.col("end").alias(f"{end}_id"), F.col("end_name").alias(f"{end}_name"), F.col("parts").alias(f"{end}_parts"))
        rel = rel.join(named, F.col(f"{end}.entityTypeId") == F.col(f"{end}_id"), "left")
        columns = F.map_from_entries(F.transform(F.col(f"c.{end}KeyRefBindings"), lambda b: F.struct(b["targetPropertyId"], b["sourceColumnName"])))
        # key columns in the order of the entity's key parts
        rel = rel.withColumn(f"{end}_of", columns).withColumn(
            f"{end}_cols", F.transform(f"{end}_parts", lambda p: F.try_element_at(f"{end}_of", p)))
    rel = rel.select("owner", "name", "source_name", "target_name", F.col("c.dataBindingTable.sourceTableName").alias("table"), "source_cols", "target_cols")

    # a spec holds a handful of rows per entity: it is meant for the driver, where plans are built
    entities, relationships = entity.orderBy("owner").collect(), rel.orderBy("owner").collect()
    _check(entities, relationships)
    return parse_ontology({
        "entities": [{"name": e.name, "table": e.table, "key": [k.name for k in e.key], "display": e.display or e.key[0].name,
                      "properties": [{"name": p.name, "source": p.source, "type": p.type or "String"} for p in e.properties if p.source is not None]}
                     for e in entities],
        "relationships": [{"name": r.name, "source": r.source_name, "target": r.target_name, "table": r.table,
                           "source_cols": list(r.source_cols), "target_cols": list(r.target_cols)} for r in relationships]})


def _check(entities: list, relationships: list) -> None:
    for what, rows in (("entity type", entities), ("relationship", relationships)):
        twice = [n for n, k in Counter(r.name for r in rows).items() if k > 1]
        if twice:
            raise ValueError(f"{what} name used twice: {', '.join(sorted(map(str, twice)))}")
    for e in entities:
        bound = {p.name for p in e.properties if p.source is not None}
        if e.table is None:
            raise ValueError(f"entity type {e.name} ({e.owner}) has no data binding")
        if not e.key or not {k.name for k in e.key} <= bound:
            raise ValueError(f"entity type {e.name} ({e.owner}): a key part is no bound property")
        if e.displayNamePropertyId is not None and e.display is None:
            raise ValueError(f"entity type {e.name} ({e.owner}): label {e.displayNamePropertyId} is no property")
    for r in relationships:
        if r.source_name is None or r.target_name is None:
            raise ValueError(f"relationship {r.name} ({r.owner}) names an unknown entity type")
        if r.table is None:
            raise ValueError(f"relationship {r.name} ({r.owner}) has no contextualization")
        if None in (r.source_cols or [None]) or None in (r.target_cols or [None]):
            raise ValueError(f"relationship {r.name} ({r.owner}) doesn't bind the whole key of both ends")
