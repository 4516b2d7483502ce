"""The evaluation domain itself: four CSV tables bound to four entity types and three
relationships, and its question set expressed with the generic templates.

Use: ``sem = domain_semantic(spark, csv_dir)`` then ``truth_table(sem, DOMAIN_QUESTIONS, batched=False)``
or any template / ``traverse`` call. Types are declared, never inferred (``active`` and
``follow_up_required`` are text ``true``/``false`` in the files and are read as BOOLEAN).
"""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans import questions as Q
from quarry.plans.bindings import Ontology, parse_ontology, spark_type
from quarry.plans.graph import traverse
from quarry.sources.tables import read_csv_table

# The domain binding (table, key, display property and typed properties per entity;
# relationships with the fact table holding both ends).
DOMAIN_SPEC: dict[str, Any] = {
    "entities": [
        {"name": "Site", "table": "sites", "key": ["site_id"], "display": "site_name",
         "properties": [{"name": "site_id"}, {"name": "site_name"}, {"name": "water_body_type"}, {"name": "region"},
                        {"name": "country"}, {"name": "latitude", "type": "Double"},
                        {"name": "longitude", "type": "Double"}, {"name": "active", "type": "Boolean"},
                        {"name": "established_year", "type": "BigInt"}]},
        {"name": "AlgaeSpecies", "table": "algae_species", "key": ["species_id"], "display": "scientific_name",
         "properties": [{"name": "species_id"}, {"name": "scientific_name"}, {"name": "common_name"},
                        {"name": "phylum"}, {"name": "toxicity_level"}, {"name": "bloom_trigger_conditions"},
                        {"name": "notes"}]},
        {"name": "WaterQualityMeasurement", "table": "water_quality_measurements", "key": ["measurement_id"],
         "display": "measurement_id",
         "properties": [{"name": "measurement_id"}, {"name": "site_id"}, {"name": "recorded_at", "type": "DateTime"},
                        {"name": "ph", "type": "Double"}, {"name": "dissolved_oxygen_mgl", "type": "Double"},
                        {"name": "turbidity_ntu", "type": "Double"}, {"name": "chlorophyll_a_ugl", "type": "Double"},
                        {"name": "nitrate_mgl", "type": "Double"}, {"name": "phosphate_mgl", "type": "Double"},
                        {"name": "algae_cell_count_cells_ml", "type": "BigInt"}, {"name": "dominant_species_id"},
                        {"name": "notes"}]},
        {"name": "TreatmentRecord", "table": "treatment_records", "key": ["treatment_id"], "display": "method",
         "properties": [{"name": "treatment_id"}, {"name": "site_id"}, {"name": "treatment_date", "type": "Date"},
                        {"name": "method"}, {"name": "dosage_or_description"}, {"name": "outcome"},
                        {"name": "follow_up_required", "type": "Boolean"}, {"name": "notes"}]},
    ],
    "relationships": [
        {"name": "hasMeasurement", "source": "Site", "target": "WaterQualityMeasurement",
         "table": "water_quality_measurements", "source_cols": ["site_id"], "target_cols": ["measurement_id"]},
        {"name": "hasTreatment", "source": "Site", "target": "TreatmentRecord", "table": "treatment_records",
         "source_cols": ["site_id"], "target_cols": ["treatment_id"]},
        {"name": "dominantSpecies", "source": "WaterQualityMeasurement", "target": "AlgaeSpecies",
         "table": "water_quality_measurements", "source_cols": ["measurement_id"],
         "target_cols": ["dominant_species_id"]},
    ],
}


def domain_ontology() -> Ontology:
    return parse_ontology(DOMAIN_SPEC)


def csv_schema(onto: Ontology, table: str) -> T.StructType:
    """Declared file schema of one table, from the binding's property types (one entity per table)."""
    e = next(x for x in onto.entities.values() if x.table == table)
    return T.StructType([T.StructField(p.source, spark_type(p.value_type)) for p in e.properties])


class CsvCatalog:
    """Tables read from ``<dir>/<table>.csv`` with declared schemas (header row, quoted commas)."""

    def __init__(self, spark: SparkSession, csv_dir: str, onto: Ontology):
        self.spark, self.sf_dir, self.onto = spark, csv_dir.rstrip("/"), onto
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = read_csv_table(self.spark, os.path.join(self.sf_dir, f"{name}.csv"),
                                                csv_schema(self.onto, name))
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


def domain_semantic(spark: SparkSession, csv_dir: str) -> Q.Semantic:
    onto = domain_ontology()
    return Q.Semantic(CsvCatalog(spark, csv_dir, onto), onto)


# --- templates over paths (C6-C11 on any binding) ------------------------------------------------

MEAS_PATH = ["Site", "hasMeasurement", "WaterQualityMeasurement"]
SPECIES_PATH = ["Site", "hasMeasurement", "WaterQualityMeasurement", "dominantSpecies", "AlgaeSpecies"]
TREAT_PATH = ["Site", "hasTreatment", "TreatmentRecord"]


def path_values(sem: Q.Semantic, path: list[str], answer: tuple[str, str], where: dict[str, str] | None = None,
                distinct: bool = True) -> DataFrame:
    """Distinct values of one property reached along a path, with per-entity filters."""
    t = traverse(sem.catalog, sem.onto, path, where=where, select={answer[0]: [answer[1]]})
    out = t.select(F.col(f"{answer[0].lower()}_{answer[1]}").alias("answer"))
    return out.distinct() if distinct else out


def path_count(sem: Q.Semantic, path: list[str], where: dict[str, str] | None = None) -> DataFrame:
    """Number of path instances."""
    first = sem.onto.entity(path[0]).key[0]
    return traverse(sem.catalog, sem.onto, path, where=where, select={path[0]: [first]}).agg(
        F.count(F.lit(1)).alias("answer"))


def path_round_agg(sem: Q.Semantic, path: list[str], value: tuple[str, str], fn: str,
                   where: dict[str, str] | None = None) -> DataFrame:
    """ROUND(AVG/MAX(value), 2) over path instances."""
    t = traverse(sem.catalog, sem.onto, path, where=where, select={value[0]: [value[1]]})
    return Q.round_agg(sem, t, f"{value[0].lower()}_{value[1]}", fn)


def path_top1(sem: Q.Semantic, path: list[str], prop: tuple[str, str]) -> DataFrame:
    """C4 after a join: most frequent value along the path, ties by value."""
    t = traverse(sem.catalog, sem.onto, path, select={prop[0]: [prop[1]]})
    return Q.top1_group(sem, t, f"{prop[0].lower()}_{prop[1]}")


def path_topk(sem: Q.Semantic, path: list[str], order: tuple[str, str], answer: tuple[str, str], k: int) -> DataFrame:
    """Answer property of the k path instances with the largest ``order`` value (ties: the
    ordering entity's key, so the result is deterministic)."""
    key = sem.onto.entity(order[0]).key[0]
    t = traverse(sem.catalog, sem.onto, path, select={order[0]: [order[1], key], answer[0]: [answer[1]]})
    o, kc = f"{order[0].lower()}_{order[1]}", f"{order[0].lower()}_{key}"
    return t.orderBy(F.col(o).desc_nulls_last(), F.col(kc)).limit(k).select(
        F.col(f"{answer[0].lower()}_{answer[1]}").alias("answer"))


def sites_in_both(sem: Q.Semantic, treat_where: str, meas_where: str) -> DataFrame:
    """C11: sites in two relationship sets at once, from one grouped pass per fact table and semi joins."""
    t = sem.view("TreatmentRecord").where(treat_where).select("site_id")
    m = sem.view("WaterQualityMeasurement").where(meas_where).select("site_id")
    return (sem.view("Site").join(t, "site_id", "left_semi").join(m, "site_id", "left_semi")
            .select(F.col("site_name").alias("answer")).distinct())


def _q(qid, cat, atype, build, split=None):
    return Q.Question(qid, cat, atype, build, split)


# The domain question set - id, category, answer type, template and its arguments.
DOMAIN_QUESTIONS: list[Q.Question] = [
    _q("S01", "single_hop", "scalar", lambda s: Q.count_where(s, "Site", "active = true")),
    _q("S02", "single_hop", "scalar", lambda s: Q.count_distinct(s, "Site", "country")),
    _q("S03", "single_hop", "set", lambda s: Q.distinct_values(s, "Site", "water_body_type")),
    _q("S04", "single_hop", "scalar", lambda s: Q.count_where(s, "AlgaeSpecies", "toxicity_level = 'high'")),
    _q("S05", "single_hop", "scalar", lambda s: Q.top1_group(s, s.view("AlgaeSpecies"), "phylum")),
    _q("S06", "single_hop", "scalar",
       lambda s: Q.round_agg(s, s.view("WaterQualityMeasurement"), "chlorophyll_a_ugl", "avg")),
    _q("S07", "single_hop", "scalar",
       lambda s: Q.round_agg(s, s.view("WaterQualityMeasurement"), "turbidity_ntu", "max")),
    _q("S08", "single_hop", "scalar", lambda s: Q.count_distinct(s, "TreatmentRecord", "method")),
    _q("M01", "multi_hop", "set",
       lambda s: path_topk(s, MEAS_PATH, ("WaterQualityMeasurement", "chlorophyll_a_ugl"), ("Site", "site_name"), 5)),
    _q("M02", "multi_hop", "set", lambda s: path_values(s, SPECIES_PATH, ("Site", "site_name"),
                                                        {"AlgaeSpecies": "phylum = 'Cyanobacteria'"})),
    _q("M03", "multi_hop", "set", lambda s: path_values(s, TREAT_PATH, ("TreatmentRecord", "method"),
                                                        {"Site": "site_name = 'Blue Lake Reservoir'"})),
    _q("M04", "multi_hop", "set", lambda s: path_values(s, SPECIES_PATH, ("Site", "site_name"),
                                                        {"AlgaeSpecies": "toxicity_level = 'high'"})),
    _q("M05", "multi_hop", "scalar", lambda s: path_count(s, MEAS_PATH, {"Site": "site_name = 'Blue Lake Reservoir'"})),
    _q("M06", "multi_hop", "set", lambda s: path_values(s, SPECIES_PATH, ("AlgaeSpecies", "scientific_name"),
                                                        {"Site": "water_body_type = 'coastal_bay_lagoon'"})),
    _q("M07", "multi_hop", "set", lambda s: path_values(s, TREAT_PATH, ("TreatmentRecord", "method"),
                                                        {"Site": "country = 'New Zealand'"})),
    _q("M08", "multi_hop", "scalar",
       lambda s: path_round_agg(s, SPECIES_PATH[2:], ("WaterQualityMeasurement", "chlorophyll_a_ugl"), "avg",
                                {"AlgaeSpecies": "scientific_name = 'Microcystis aeruginosa'"})),
    _q("M09", "multi_hop", "scalar", lambda s: path_top1(s, SPECIES_PATH[2:], ("AlgaeSpecies", "scientific_name"))),
    _q("M10", "multi_hop", "set", lambda s: sites_in_both(s, "outcome = 'successful'", "chlorophyll_a_ugl > 200")),
    _q("T-S01", "single_hop", "scalar", lambda s: Q.count_where(s, "Site", "water_body_type = 'lake'"), "train"),
    _q("T-S02", "single_hop", "scalar", lambda s: Q.count_where(s, "Site", "country = 'Australia'"), "train"),
    _q("T-S03", "single_hop", "set", lambda s: Q.distinct_values(s, "AlgaeSpecies", "toxicity_level"), "train"),
    _q("T-S04", "single_hop", "scalar", lambda s: Q.count_where(s, "AlgaeSpecies", "phylum = 'Bacillariophyta'"),
       "train"),
    _q("T-S05", "single_hop", "scalar",
       lambda s: Q.round_agg(s, s.view("WaterQualityMeasurement"), "dissolved_oxygen_mgl", "avg"), "dev"),
    _q("T-S06", "single_hop", "scalar",
       lambda s: Q.round_agg(s, s.view("WaterQualityMeasurement"), "nitrate_mgl", "max"), "dev"),
    _q("T-M01", "multi_hop", "set",
       lambda s: path_topk(s, MEAS_PATH, ("WaterQualityMeasurement", "turbidity_ntu"), ("Site", "site_name"), 5),
       "train"),
    _q("T-M02", "multi_hop", "set", lambda s: path_values(s, SPECIES_PATH, ("Site", "site_name"),
                                                          {"AlgaeSpecies": "phylum = 'Dinoflagellata'"}), "train"),
    _q("T-M03", "multi_hop", "set", lambda s: path_values(s, TREAT_PATH, ("TreatmentRecord", "method"),
                                                          {"Site": "site_name = 'Lake Rotorua Central'"}), "train"),
    _q("T-M04", "multi_hop", "set", lambda s: path_values(s, SPECIES_PATH, ("AlgaeSpecies", "scientific_name"),
                                                          {"Site": "water_body_type = 'estuary'"}), "train"),
    _q("T-M05", "multi_hop", "scalar",
       lambda s: path_count(s, MEAS_PATH, {"Site": "site_name = 'Sacramento River at Redding'"}), "train"),
    _q("T-M06", "multi_hop", "set", lambda s: path_values(s, TREAT_PATH, ("TreatmentRecord", "method"),
                                                          {"Site": "country = 'USA'"}), "dev"),
    _q("T-M07", "multi_hop", "scalar",
       lambda s: path_round_agg(s, SPECIES_PATH[2:], ("WaterQualityMeasurement", "chlorophyll_a_ugl"), "avg",
                                {"AlgaeSpecies": "scientific_name = 'Anabaena flos-aquae'"}), "dev"),
    _q("T-M08", "multi_hop", "set", lambda s: path_values(s, SPECIES_PATH, ("Site", "site_name"),
                                                          {"AlgaeSpecies": "toxicity_level = 'moderate'"}), "dev"),
] + [Q.Question(i, "negative", "refusal", None, sp) for i, sp in
     [("N01", None), ("N02", None), ("N03", None), ("N04", None), ("N05", None), ("N06", None),
      ("T-N01", "train"), ("T-N02", "train"), ("T-N03", "train"), ("T-N04", "dev")]]
