"""Dataset jobs on rows that show each rule."""
import json

import pytest

from fuzzyspark.operators import datasets as DS
from fuzzyspark.operators import entities as EN
from fuzzyspark.sources import io as IO

WIKI = "https://example.org/wiki/"
LABELS = [("P1", "author"), ("P2", "shop ID"), ("P3", "title"), ("P4", "year"), ("Q1", "Storm"), ("Q2", "Calm"), ("Q3", "Rain"), ("Q50", "Ann")]
JUDGED = [
    ("s1", WIKI + "Storm", "name`author`author`ISBNID", "the storm`B`A`123", "yes"),
    ("s1", WIKI + "Storm", "name`author", "the storm`B", "yes"),                  # the same subject again
    ("s2", WIKI + "Calm", "name`author`", "calm", "insufficient_info"),           # parts without partner
    ("s3", WIKI + "Rain", "name`author", "rain`C", "no"),
    ("s4", WIKI + "Nowhere", "name`author", "none`D", "yes"),                     # no such entity
    ("s5", WIKI + "Calm", "", "", "yes"),                                         # no description
    ("s6", None, "name`author", "x`E", "yes"), (None, WIKI + "Calm", "name", "y", "yes"), ("s7", "no page", None, None, None),
]
CLAIMS = [
    ("Q1", "P1", json.dumps({"entity-type": "item", "id": "Q50"}), 2), ("Q1", "P1", json.dumps("Zed"), 1), ("Q1", "P1", json.dumps("Zed"), 1),
    ("Q1", "P2", json.dumps("77"), 1), ("Q1", "P3", json.dumps("claimed title"), 1), ("Q1", "P4", json.dumps({"time": "+1998-01-01"}), 1),
    ("Q2", "P1", "{broken", 1), ("Q2", "P1", None, 2), ("Q9", "P1", json.dumps("not judged"), 1), (None, "P1", json.dumps("x"), 1),
]


def _inputs(spark, parts=3, empty=False):
    make = lambda rows, schema: spark.createDataFrame([] if empty else rows, schema).repartition(parts)
    judged = make([(*r, "clash") for r in JUDGED], "subject_id string, page string, predicates string, objects string, match string, entity string")
    pages = make([("Storm", "Q1"), ("Storm", "Q8"), ("Calm", "Q2"), ("Rain", "Q3"), (None, "Q4")], "title string, entity string")
    claims = make(CLAIMS, "entity string, property string, claim string, ord long")
    return judged, pages, claims, make(LABELS, "id string, label string")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


MAPPING = {"title": "title", "author": "author", "shop ID": "shop"}


def test_make_dataset_full(spark):
    left, right, gt = DS.make_dataset(*_inputs(spark), MAPPING)
    assert left.columns == right.columns == ["id", "title", "author", "shop"]
    assert _rows(left) == sorted([("Q1", "Storm", "Zed|Zed|Ann", None), ("Q2", "Calm", None, None), ("Q3", "Rain", None, None)], key=repr)
    assert _rows(right) == sorted([("s1", "the storm", "A B", None), ("s2", "calm", None, None), ("s3", "rain", "C", None),
                                   ("s4", "none", "D", None), ("s6", "x", "E", None)], key=repr)
    assert gt.columns == ["id_l", "id_r", "title_l", "author_l", "shop_l", "title_r", "author_r", "shop_r"]
    assert _rows(gt) == [("Q1", "s1", "Storm", "Zed|Zed|Ann", None, "the storm", "A B", None),
                         ("Q2", "s2", "Calm", None, None, "calm", None, None)]


def test_make_dataset_variants(spark):
    inputs = _inputs(spark)
    left, right, gt = DS.make_dataset(*inputs, MAPPING, "1col")
    assert _rows(left) == [("Q1", "Storm"), ("Q2", "Calm"), ("Q3", "Rain")] and right.count() == 5
    assert _rows(gt) == [("Q1", "s1", "Storm", "the storm"), ("Q2", "s2", "Calm", "calm")]
    left, right, gt = DS.make_dataset(*inputs, MAPPING, "2col")
    assert _rows(left) == [("Q1", "Storm", "Zed|Zed|Ann")]
    assert [r[0] for r in _rows(right)] == ["s1", "s3", "s4", "s6"]
    assert _rows(gt) == [("Q1", "s1", "Storm", "Zed|Zed|Ann", "the storm", "A B")]
    _, _, gt = DS.make_dataset(*inputs, MAPPING, "1col", keep=["no"])
    assert [r[:2] for r in _rows(gt)] == [("Q3", "s3")]


def test_make_dataset_empty(spark):
    for df in DS.make_dataset(*_inputs(spark, empty=True), MAPPING):
        assert df.count() == 0


def test_title_is_the_label_of_the_entity(spark):
    judged, pages, claims, labels = _inputs(spark)
    left, _, _ = DS.make_dataset(judged, pages, claims, labels.where("id <> 'Q1'"), MAPPING, "1col")
    assert ("Q1", "claimed title") in _rows(left)  # an entity without label keeps a title that it claims


def _binding(e, p, v, kind="literal", lang=None):
    cell = {"type": kind, "value": v} | ({"xml:lang": lang} if lang else {})
    return {"entId": {"type": "uri", "value": e}, "propName": {"type": "uri", "value": p}, "propStr": cell}


def test_augmentation_of_read_triples(spark, tmp_path):
    e, p = "http://x.org/entity/", "http://x.org/prop/"
    rows = [_binding(e + "Q1", p + "P1", "Anne", lang="fr"), _binding(e + "Q1", p + "P1", "Ann", lang="en"), _binding(e + "Q1", p + "P1", "Ana", lang="es"),
            _binding(e + "Q1", p + "P4", e + "statement/Q1-7", "uri"), _binding(e + "Q2", p + "maker", e + "Q50", "uri"),
            _binding(e + "Q7", p + "P1", "no label of its own"), _binding(e + "Q2", p + "maker", e + "Q50", "uri"),
            {"entId": {"type": "uri", "value": e + "Q3"}}]
    (tmp_path / "doc.json").write_text(json.dumps({"head": {}, "results": {"bindings": rows}}, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    labels = spark.createDataFrame(LABELS, "id string, label string")
    for name, lines in (("doc.json", False), ("lines.json", True)):
        t = IO.read_triples(spark, str(tmp_path / name), lines=lines)
        assert t.columns == ["entity", "property", "value", "kind", "lang", "ord"] and t.count() == len(rows)
        out = DS.make_augmentation(t, labels, {"id": "id", "title (en)": "title", "author": "author", "maker": "maker"})
        assert _rows(out) == [("Q1", "Storm", "Ann", None), ("Q2", "Calm", None, "Ann")]
    assert DS.make_augmentation(t, labels, {"author": "title"}).count() == 2
    assert DS.make_augmentation(t.limit(0), labels, {"id": "id", "title (en)": "title"}).count() == 0
    with pytest.raises(ValueError):
        DS.make_augmentation(t, labels, {"author": "author"})
    assert EN.entity_properties(t, labels).count() == 3
