"""Claims and triples on rows that show each rule."""
import json

from fuzzyspark.operators import entities as EN

LABELS = [("Q1", "France"), ("Q1", "Frankreich"), ("Q9", "metre"), ("P17", "country"), (None, "nobody")]


def _labels(spark):
    return spark.createDataFrame(LABELS, "id string, label string")


def test_claim_shapes(spark):
    cases = [
        ("plain", "plain"), ({"entity-type": "item", "id": "Q1"}, "France"), ({"entity-type": "item", "id": "Q77"}, "Q77"),
        ({"time": "+1998-07-12T00:00:00Z"}, "1998"), ({"time": "12 July"}, "12 July"),
        ({"latitude": 48, "longitude": 2}, "(48, 2)"), ({"latitude": 48.5, "longitude": -2.25}, "(48.5, -2.25)"),
        ({"text": "Bonjour", "language": "fr"}, "Bonjour"), ({"unit": "http://x.org/entity/Q9", "amount": "+7"}, "+7 metre"),
        ({"unit": "http://x.org/entity/Q8", "amount": "+7"}, "+7 Q8"), ({"unit": "1", "amount": "+7"}, "+7 1"),
        ({"mainsnak": {"datavalue": {"value": "deep"}}}, "deep"),
        ({"mainsnak": {"datavalue": {"value": {"id": "Q1"}}}}, '{"id":"Q1"}'),
        ({"other": 1}, '{"other":1}'), (12, "12"), ([1, 2], "[1,2]"), ("", ""), ("x" * 300_000, "x" * 300_000),
        # both time and unit: the first shape that fits
        ({"time": "+2001", "unit": "http://x.org/Q9"}, "2001"),
    ]
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(97, None), (98, "{broken"), (99, "null"), (0, json.dumps("plain"))]
    df = spark.createDataFrame([(i, c, "a", "b", "c") for i, c in rows], "n int, claim string, key string, label string, _key string")
    out = EN.claim_text(df, "claim", _labels(spark), "text")
    assert out.columns == ["n", "claim", "key", "label", "_key", "text"]
    got = out.collect()
    want = {i: t for i, (_, t) in enumerate(cases)} | {97: None, 98: None, 99: None}
    assert len(got) == len(rows) and all(r["text"] == want[r["n"]] for r in got), [(r["n"], r["text"]) for r in got if r["text"] != want[r["n"]]]
    assert {(r["key"], r["label"], r["_key"]) for r in got} == {("a", "b", "c")}
    assert EN.claim_text(df.limit(0), "claim", _labels(spark), "claim").columns == ["n", "key", "label", "_key", "claim"]


def test_entity_properties(spark):
    e, p = "http://x.org/entity/", "http://x.org/prop/"
    rows = [
        (e + "Q5", p + "P17", e + "Q1", "uri", None, 1),                       # both labelled
        (e + "Q5", p + "P99", "kept", "literal", None, 2),                     # no label: the id
        (e + "Q5", "http://x.org/schema#name", "eins", "literal", "de", 3),
        (e + "Q5", "http://x.org/schema#name", "one", "literal", "en", 4),     # the first in the language
        (e + "Q5", "http://x.org/schema#name", "uno", "literal", "en", 5),
        (e + "Q5", "http://x.org/schema#name", "un", "literal", "fr", 6),
        (e + "Q5", p + "seen", "a", "literal", "de", 1), (e + "Q5", p + "seen", "b", "literal", None, 2),   # the last
        (e + "Q5", p + "site", "http://home.org/", "uri", None, 1),            # no item: as it is
        (e + "Q5", p + "gone", e + "Q404", "uri", None, 1),                    # an item without label
        (e + "Q5", p + "stmt", e + "statement/Q5-1", "uri", None, 1),
        (e + "Q5", p + "null", None, "literal", "en", 1),
        (e + "Q5", p + "tie", "x", "literal", None, 7), (e + "Q5", p + "tie", "y", "literal", None, 7),
        (e + "Q5", p + "tie", "y", "literal", None, 7),                        # repeated row
        (e + "Q6", p + "P17", e + "Q404", "uri", None, 1),                     # nothing left: no row
        ("no iri", p + "seen", "a", "literal", None, 1), (e + "Q7", "noprop", "a", "literal", None, 1), (None, None, None, None, None, None),
    ]
    t = spark.createDataFrame(rows, "entity string, property string, value string, kind string, lang string, ord long")
    want = {"country": "France", "P99": "kept", "name": "one", "seen": "b", "site": "http://home.org/", "tie": "y"}
    for parts in (1, 5):
        out = EN.entity_properties(t.repartition(parts), _labels(spark))
        assert {r["entity"]: r["props"] for r in out.collect()} == {"Q5": want}
    cols = EN.property_columns(out, ["name", "absent"]).collect()
    assert [tuple(r) for r in cols] == [("Q5", "one", None)]
    assert EN.entity_properties(t.limit(0), _labels(spark)).count() == 0
    assert EN.entity_properties(t, _labels(spark), prefer="fr").first()["props"]["name"] == "un"


def test_rows_without_a_key_are_spread_in_a_join_by_id(spark, monkeypatch):
    monkeypatch.setattr(EN, "LABEL_BROADCAST_ROWS", 0)
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("z", 4)], "k string, spread int")
    labels = spark.createDataFrame([("a", "A"), (None, "none"), ("b", "B")], "id string, label string")
    got = EN.with_label(df, "k", labels, "out")
    assert got.columns == ["k", "spread", "out"]
    assert {tuple(r) for r in got.collect()} == {("a", 1, "A"), (None, 2, None), (None, 3, None), ("z", 4, None)}
    assert "monotonically_increasing_id" in got._jdf.queryExecution().optimizedPlan().toString()
