"""The evaluation domain: CSV tables with declared types, bound entities and relationships, and the
32 answerable domain questions checked against SQL run by DuckDB on the same small fixture."""

import csv
import os
import tempfile

import duckdb
import pytest

from quarry.plans import domain as DM
from quarry.plans import truth as TR

SITES = [
    ("S1", "Blue Lake Reservoir", "lake", "North", "USA", 40.1, -105.2, "true", 1990),
    ("S2", "Lake Rotorua Central", "lake", "Bay", "New Zealand", -38.1, 176.2, "true", 1985),
    ("S3", "Sacramento River at Redding", "river", "West", "USA", 40.6, -122.4, "false", 2001),
    ("S4", "Harbour Flats", "coastal_bay_lagoon", "South", "Australia", -33.8, 151.2, "true", 1999),
    ("S5", "Mouth Bay", "estuary", "South", "Australia", -34.9, 138.5, "false", 2010),
    ("S6", "Taupo Edge", "lake", "Central", "New Zealand", -38.7, 176.1, "true", 1978),
]
SPECIES = [
    ("A1", "Microcystis aeruginosa", "microcystis", "Cyanobacteria", "high", "warm, still water", "n1"),
    ("A2", "Anabaena flos-aquae", "anabaena", "Cyanobacteria", "moderate", "nitrogen, light", ""),
    ("A3", "Karenia brevis", "red tide", "Dinoflagellata", "high", "salinity", "n3"),
    ("A4", "Cyclotella meneghiniana", "diatom", "Bacillariophyta", "none", "silica", ""),
    ("A5", "Spirogyra spp.", "water silk", "Chlorophyta", "low", "shallow, clear", "n5"),
]
MEAS = [  # id, site, time, ph, do, turb, chl, nitrate, phosphate, cells, species, notes
    ("W01", "S1", "2023-06-01 10:00:00", 7.1, 8.2, 12.5, 150.2, 1.1, 0.2, 1000, "A1", ""),
    ("W02", "S1", "2023-07-01 10:00:00", 7.3, 7.9, 30.1, 210.7, 1.4, 0.3, 5000, "A2", ""),
    ("W03", "S2", "2023-06-02 09:00:00", 6.9, 9.1, 5.2, 80.4, 0.4, 0.1, 200, "A5", ""),
    ("W04", "S2", "2023-08-02 09:00:00", 7.0, 8.8, 44.0, 250.9, 2.2, 0.5, 9000, "A1", ""),
    ("W05", "S3", "2023-05-03 08:00:00", 7.5, 7.1, 18.9, 60.0, 3.3, 0.6, 300, "", "no bloom"),
    ("W06", "S3", "2023-09-03 08:00:00", 7.6, 6.8, 22.4, 95.5, 2.9, 0.4, 800, "A4", ""),
    ("W07", "S4", "2023-06-04 12:00:00", 8.0, 6.5, 3.3, 120.0, 0.9, 0.2, 1500, "A3", ""),
    ("W08", "S4", "2023-07-04 12:00:00", 8.1, 6.2, 9.9, 205.5, 1.0, 0.2, 7000, "A3", ""),
    ("W09", "S5", "2023-06-05 07:00:00", 7.8, 7.5, 27.7, 45.1, 1.8, 0.3, 100, "A4", ""),
    ("W10", "S5", "2023-08-05 07:00:00", 7.9, 7.7, 30.1, 130.3, 1.6, 0.3, 2500, "A2", ""),
    ("W11", "S6", "2023-06-06 11:00:00", 7.2, 8.9, 1.2, 30.0, 0.2, 0.1, 50, "A5", ""),
    ("W12", "S6", "2023-09-06 11:00:00", 7.4, 8.5, 2.5, 260.0, 0.3, 0.1, 12000, "A1", ""),
]
TREAT = [  # id, site, date, method, dosage, outcome, follow_up, notes
    ("T1", "S1", "2023-07-10", "copper sulfate", "2 mg/L", "successful", "false", ""),
    ("T2", "S1", "2023-08-10", "aeration", "continuous", "partial", "true", ""),
    ("T3", "S2", "2023-08-15", "aeration", "night only", "successful", "false", ""),
    ("T4", "S2", "2023-09-15", "barley straw", "bales, 4", "ongoing", "true", "quoted, note"),
    ("T5", "S4", "2023-07-20", "clay flocculation", "50 g/m2", "successful", "false", ""),
    ("T6", "S6", "2023-10-01", "ultrasound", "24/7", "successful", "true", ""),
    ("T7", "S3", "2023-10-05", "dredging", "sediment", "unsuccessful", "false", ""),
]

COLS = {
    "sites": {"site_id": "VARCHAR", "site_name": "VARCHAR", "water_body_type": "VARCHAR", "region": "VARCHAR",
              "country": "VARCHAR", "latitude": "DOUBLE", "longitude": "DOUBLE", "active": "BOOLEAN",
              "established_year": "BIGINT"},
    "algae_species": {"species_id": "VARCHAR", "scientific_name": "VARCHAR", "common_name": "VARCHAR",
                      "phylum": "VARCHAR", "toxicity_level": "VARCHAR", "bloom_trigger_conditions": "VARCHAR",
                      "notes": "VARCHAR"},
    "water_quality_measurements": {"measurement_id": "VARCHAR", "site_id": "VARCHAR", "recorded_at": "TIMESTAMP",
                                   "ph": "DOUBLE", "dissolved_oxygen_mgl": "DOUBLE", "turbidity_ntu": "DOUBLE",
                                   "chlorophyll_a_ugl": "DOUBLE", "nitrate_mgl": "DOUBLE", "phosphate_mgl": "DOUBLE",
                                   "algae_cell_count_cells_ml": "BIGINT", "dominant_species_id": "VARCHAR",
                                   "notes": "VARCHAR"},
    "treatment_records": {"treatment_id": "VARCHAR", "site_id": "VARCHAR", "treatment_date": "DATE",
                          "method": "VARCHAR", "dosage_or_description": "VARCHAR", "outcome": "VARCHAR",
                          "follow_up_required": "BOOLEAN", "notes": "VARCHAR"},
}

SM = ("FROM water_quality_measurements m JOIN sites s ON m.site_id = s.site_id "
      "JOIN algae_species a ON m.dominant_species_id = a.species_id")
SQL = {  # (kind, SQL with column answer): kind num | text | set
    "S01": ("num", "SELECT COUNT(*) AS answer FROM sites WHERE active = true"),
    "S02": ("num", "SELECT COUNT(DISTINCT country) AS answer FROM sites"),
    "S03": ("set", "SELECT DISTINCT water_body_type AS answer FROM sites"),
    "S04": ("num", "SELECT COUNT(*) AS answer FROM algae_species WHERE toxicity_level = 'high'"),
    "S05": ("text", "SELECT phylum AS answer FROM algae_species GROUP BY phylum ORDER BY COUNT(*) DESC, phylum LIMIT 1"),
    "S06": ("num", "SELECT ROUND(AVG(chlorophyll_a_ugl), 2) AS answer FROM water_quality_measurements"),
    "S07": ("num", "SELECT ROUND(MAX(turbidity_ntu), 2) AS answer FROM water_quality_measurements"),
    "S08": ("num", "SELECT COUNT(DISTINCT method) AS answer FROM treatment_records"),
    "M01": ("set", "SELECT s.site_name AS answer FROM water_quality_measurements m JOIN sites s ON m.site_id = s.site_id "
                   "ORDER BY m.chlorophyll_a_ugl DESC, m.measurement_id LIMIT 5"),
    "M02": ("set", f"SELECT DISTINCT s.site_name AS answer {SM} WHERE a.phylum = 'Cyanobacteria'"),
    "M03": ("set", "SELECT DISTINCT t.method AS answer FROM treatment_records t JOIN sites s ON t.site_id = s.site_id "
                   "WHERE s.site_name = 'Blue Lake Reservoir'"),
    "M04": ("set", f"SELECT DISTINCT s.site_name AS answer {SM} WHERE a.toxicity_level = 'high'"),
    "M05": ("num", "SELECT COUNT(*) AS answer FROM water_quality_measurements m JOIN sites s ON m.site_id = s.site_id "
                   "WHERE s.site_name = 'Blue Lake Reservoir'"),
    "M06": ("set", f"SELECT DISTINCT a.scientific_name AS answer {SM} WHERE s.water_body_type = 'coastal_bay_lagoon'"),
    "M07": ("set", "SELECT DISTINCT t.method AS answer FROM treatment_records t JOIN sites s ON t.site_id = s.site_id "
                   "WHERE s.country = 'New Zealand'"),
    "M08": ("num", "SELECT ROUND(AVG(m.chlorophyll_a_ugl), 2) AS answer FROM water_quality_measurements m "
                   "JOIN algae_species a ON m.dominant_species_id = a.species_id "
                   "WHERE a.scientific_name = 'Microcystis aeruginosa'"),
    "M09": ("text", "SELECT a.scientific_name AS answer FROM water_quality_measurements m JOIN algae_species a "
                    "ON m.dominant_species_id = a.species_id GROUP BY a.scientific_name "
                    "ORDER BY COUNT(*) DESC, a.scientific_name LIMIT 1"),
    "M10": ("set", "SELECT DISTINCT site_name AS answer FROM sites WHERE site_id IN (SELECT site_id FROM "
                   "treatment_records WHERE outcome = 'successful') AND site_id IN (SELECT site_id FROM "
                   "water_quality_measurements WHERE chlorophyll_a_ugl > 200)"),
    "T-S01": ("num", "SELECT COUNT(*) AS answer FROM sites WHERE water_body_type = 'lake'"),
    "T-S02": ("num", "SELECT COUNT(*) AS answer FROM sites WHERE country = 'Australia'"),
    "T-S03": ("set", "SELECT DISTINCT toxicity_level AS answer FROM algae_species"),
    "T-S04": ("num", "SELECT COUNT(*) AS answer FROM algae_species WHERE phylum = 'Bacillariophyta'"),
    "T-S05": ("num", "SELECT ROUND(AVG(dissolved_oxygen_mgl), 2) AS answer FROM water_quality_measurements"),
    "T-S06": ("num", "SELECT ROUND(MAX(nitrate_mgl), 2) AS answer FROM water_quality_measurements"),
    "T-M01": ("set", "SELECT s.site_name AS answer FROM water_quality_measurements m JOIN sites s ON m.site_id = s.site_id "
                     "ORDER BY m.turbidity_ntu DESC, m.measurement_id LIMIT 5"),
    "T-M02": ("set", f"SELECT DISTINCT s.site_name AS answer {SM} WHERE a.phylum = 'Dinoflagellata'"),
    "T-M03": ("set", "SELECT DISTINCT t.method AS answer FROM treatment_records t JOIN sites s ON t.site_id = s.site_id "
                     "WHERE s.site_name = 'Lake Rotorua Central'"),
    "T-M04": ("set", f"SELECT DISTINCT a.scientific_name AS answer {SM} WHERE s.water_body_type = 'estuary'"),
    "T-M05": ("num", "SELECT COUNT(*) AS answer FROM water_quality_measurements m JOIN sites s ON m.site_id = s.site_id "
                     "WHERE s.site_name = 'Sacramento River at Redding'"),
    "T-M06": ("set", "SELECT DISTINCT t.method AS answer FROM treatment_records t JOIN sites s ON t.site_id = s.site_id "
                     "WHERE s.country = 'USA'"),
    "T-M07": ("num", "SELECT ROUND(AVG(m.chlorophyll_a_ugl), 2) AS answer FROM water_quality_measurements m "
                     "JOIN algae_species a ON m.dominant_species_id = a.species_id "
                     "WHERE a.scientific_name = 'Anabaena flos-aquae'"),
    "T-M08": ("set", f"SELECT DISTINCT s.site_name AS answer {SM} WHERE a.toxicity_level = 'moderate'"),
}


@pytest.fixture(scope="module")
def csv_dir():
    d = tempfile.mkdtemp(prefix="quarry-domain-")
    for name, rows in (("sites", SITES), ("algae_species", SPECIES), ("water_quality_measurements", MEAS),
                       ("treatment_records", TREAT)):
        with open(os.path.join(d, f"{name}.csv"), "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(list(COLS[name]))
            w.writerows(rows)
    return d


def duck(csv_dir):
    con = duckdb.connect()
    for name, cols in COLS.items():
        spec = "{" + ", ".join(f"'{c}': '{t}'" for c, t in cols.items()) + "}"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_csv('{csv_dir}/{name}.csv', header = true, "
                    f"columns = {spec})")
    return con


def test_declared_types(spark, csv_dir):
    sem = DM.domain_semantic(spark, csv_dir)
    site = sem.view("Site")
    assert dict(site.dtypes)["active"] == "boolean"
    assert site.where("active").count() == 4
    assert sem.view("AlgaeSpecies").where("species_id = 'A1'").first().bloom_trigger_conditions == "warm, still water"
    assert sem.view("WaterQualityMeasurement").where("dominant_species_id IS NULL").count() == 1


def test_domain_questions_match_sql(spark, csv_dir):
    sem = DM.domain_semantic(spark, csv_dir)
    truth = TR.truth_table(sem, DM.DOMAIN_QUESTIONS, batched=False, checkpoint=False).collect()
    got = {}
    for r in truth:
        got.setdefault(r.id, []).append(r)
    con = duck(csv_dir)
    assert len(SQL) == 32
    for qid, (kind, sql) in SQL.items():
        rows = [x[0] for x in con.execute(sql).fetchall()]
        mine = got[qid]
        if kind == "num":
            exp = round(float(rows[0]), 2) if rows and rows[0] is not None else None
            assert mine[0].value_num == exp, qid
        elif kind == "text":
            assert mine[0].value_text == (rows[0] if rows else None), qid
        else:
            assert sorted(r.value_text for r in mine if r.value_text is not None) == sorted(
                str(x) for x in rows if x is not None), qid
    assert all(got[i][0].answer_type == "refusal" for i in ("N01", "T-N04"))


def test_domain_graph_edges(spark, csv_dir):
    from quarry.plans.graph import dangling_edges, graph_edges, graph_nodes

    sem = DM.domain_semantic(spark, csv_dir)
    edges = graph_edges(sem.catalog, sem.onto)
    counts = {r.rel_type: r["count"] for r in edges.groupBy("rel_type").count().collect()}
    # the blank dominant species is not an edge
    assert counts == {"hasMeasurement": 12, "hasTreatment": 7, "dominantSpecies": 11}
    assert dangling_edges(edges, graph_nodes(sem.catalog, sem.onto), "dst_key").count() == 0
