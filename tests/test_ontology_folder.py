"""An ontology folder gives the Ontology of the equal dict; broken folders are named."""

import json

import pytest

from quarry.plans import graph as G
from quarry.plans.bindings import DRIVER_SPEC, driver_ontology, parse_ontology
from quarry.plans.domain import DOMAIN_SPEC
from quarry.plans.ontology_folder import read_ontology


def write_folder(root, spec, change=None):
    """``spec`` (the dict form) as documents that name each other by id; ``change`` edits them before they
    are written (path -> document)."""
    docs, entity_ids, prop_ids = {}, {}, {}
    for i, e in enumerate(spec["entities"], 1):
        eid = entity_ids[e["name"]] = str(1000 + i)
        for j, p in enumerate(e["properties"]):
            prop_ids[e["name"], p["name"]] = f"{eid}{j:03}"
        docs[f"EntityTypes/{eid}/definition.json"] = {
            "id": eid, "name": e["name"], "namespace": "x", "description": "a, \"b\"\n", "entityIdParts": [prop_ids[e["name"], k] for k in e["key"]],
            "displayNamePropertyId": prop_ids.get((e["name"], e["display"])),
            "properties": [{"id": prop_ids[e["name"], p["name"]], "name": p["name"], "valueType": p.get("type", "String"), "redefines": None}
                           for p in reversed(e["properties"])][::-1]}
        docs[f"EntityTypes/{eid}/DataBindings/b{i}.json"] = {"id": f"b{i}", "dataBindingConfiguration": {
            "propertyBindings": [{"sourceColumnName": p.get("source", p["name"]), "targetPropertyId": prop_ids[e["name"], p["name"]]}
                                 for p in reversed(e["properties"])], "sourceTableProperties": {"sourceTableName": e["table"], "sourceSchema": "s"}}}
    keys = {e["name"]: e["key"] for e in spec["entities"]}
    for i, r in enumerate(spec["relationships"], 1):
        rid = str(2000 + i)
        docs[f"RelationshipTypes/{rid}/definition.json"] = {
            "id": rid, "name": r["name"], "source": {"entityTypeId": entity_ids[r["source"]]}, "target": {"entityTypeId": entity_ids[r["target"]]}}
        refs = lambda end: [{"sourceColumnName": c, "targetPropertyId": prop_ids[r[end], k]}
                            for c, k in zip(r[f"{end}_cols"], keys[r[end]])][::-1]
        docs[f"RelationshipTypes/{rid}/Contextualizations/c{i}.json"] = {
            "dataBindingTable": {"sourceTableName": r["table"]}, "sourceKeyRefBindings": refs("source"), "targetKeyRefBindings": refs("target")}
    docs["definition.json"] = {"name": "not read"}
    if change:
        change(docs)
    for path, doc in docs.items():
        to = root / path
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=2))
    return str(root)


def in_folder_form(spec):
    """``spec`` without what documents can't hold: row filters, and labels that are no property (the key's first
    part stands in)."""
    def entity(e):
        names = [p["name"] for p in e["properties"]]
        return {k: v for k, v in e.items() if k != "where"} | {"display": e["display"] if e["display"] in names else e["key"][0]}

    return {**spec, "entities": [entity(e) for e in spec["entities"]]}


@pytest.mark.parametrize("spec", [DOMAIN_SPEC, DRIVER_SPEC], ids=["domain", "driver"])
def test_folder_equals_dict(spark, tmp_path, spec):
    spec = in_folder_form(spec)
    got, want = read_ontology(spark, write_folder(tmp_path / "o", spec)), parse_ontology(spec)
    assert list(got.entities.items()) == list(want.entities.items())
    assert list(got.relationships.items()) == list(want.relationships.items())
    assert got.source_tables() == want.source_tables()


def test_folder_answers_like_the_driver_ontology(spark, catalog, tmp_path):
    onto = read_ontology(spark, write_folder(tmp_path / "o", in_folder_form(DRIVER_SPEC)))
    a, b = (G.graph_edges(catalog, o) for o in (onto, driver_ontology()))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("change, message", [
    (lambda d: d.pop("EntityTypes/1001/DataBindings/b1.json"), "no data binding"),
    (lambda d: d["EntityTypes/1001/definition.json"].update(entityIdParts=["9"]), "key part"),
    (lambda d: d["EntityTypes/1002/definition.json"].update(displayNamePropertyId="9"), "label 9"),
    (lambda d: d["EntityTypes/1002/definition.json"].update(name="Site"), "used twice: Site"),
    (lambda d: d["RelationshipTypes/2001/definition.json"].update(target={"entityTypeId": "9"}), "unknown entity type"),
    (lambda d: d.pop("RelationshipTypes/2002/Contextualizations/c2.json"), "no contextualization"),
    (lambda d: d["RelationshipTypes/2003/Contextualizations/c3.json"].update(targetKeyRefBindings=[]), "whole key"),
])
def test_broken_folders_are_named(spark, tmp_path, change, message):
    with pytest.raises(ValueError, match=message):
        read_ontology(spark, write_folder(tmp_path / "o", DOMAIN_SPEC, change))


def test_document_that_is_no_json_fails(spark, tmp_path):
    folder = write_folder(tmp_path / "o", DOMAIN_SPEC, lambda d: d.update({"EntityTypes/1001/definition.json": "{broken"}))
    with pytest.raises(Exception, match="(?i)malformed"):
        read_ontology(spark, folder)


def test_first_binding_and_unbound_properties(spark, tmp_path):
    def change(d):
        d["EntityTypes/1001/DataBindings/a0.json"] = {"dataBindingConfiguration": {
            "propertyBindings": [{"sourceColumnName": "other", "targetPropertyId": "1001000"}], "sourceTableProperties": {"sourceTableName": "sites2"}}}
    e = read_ontology(spark, write_folder(tmp_path / "o", DOMAIN_SPEC, change)).entity("Site")
    assert e.table == "sites2" and [(p.name, p.source) for p in e.properties] == [("site_id", "other")]
