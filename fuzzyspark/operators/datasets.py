"""Jobs that build the inputs of a fuzzy join from judged entity data.

``make_dataset`` turns judged descriptions into L, R and the truth;
``make_augmentation`` turns triples into further rows of L.  Both take the
alignment of attributes as a mapping {name in L: name in R}.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzyspark.operators import entities as EN
from fuzzyspark.operators import prep as PR

PAGE_RE = r"wiki/(.*)$"
# The judgements that count as a match
MATCHES = ("yes", "insufficient_info")


def claimed_properties(claims: DataFrame, labels: DataFrame, drop: str = "ID") -> DataFrame:
    """``(entity, props: map<string, string>)`` from claims (entity, property, claim, ord).

    A property is called by its label, by its id where it has none; names that
    match ``drop`` are left out.  Several values of a name are joined by a bar
    in the order of ``ord``, equal ones by size.  Null and malformed claims are
    dropped, and an entity without any other has no row."""
    t = EN.claim_text(claims.select("entity", "property", "claim", "ord"), "claim", labels, "text")
    t = EN.with_label(t.where("entity IS NOT NULL AND property IS NOT NULL AND text IS NOT NULL"), "property", labels, "plabel")
    t = t.select("entity", F.coalesce("plabel", "property").alias("name"), "ord", "text").where(~F.col("name").rlike(drop))
    values = F.array_sort(F.collect_list(F.struct("ord", "text")))
    one = t.groupBy("entity", "name").agg(F.array_join(F.transform(values, lambda v: v["text"]), "|").alias("text"))
    return one.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("props"))


def described_properties(judged: DataFrame, sep: str = "`", drop: str = "ID", title: str = "name") -> DataFrame:
    """``(subject_id, props)`` from descriptions whose predicates and objects are packed in two strings.

    The lists are paired by position; a part without partner and one with an
    empty predicate are dropped.  The distinct objects of a predicate, over all
    rows of the subject, are joined by a space in code point order.  ``title``
    is called ``title``; names that match ``drop`` are left out."""
    parts = (PR.packed_split(judged.where("subject_id IS NOT NULL"), "subject_id", "predicates", "objects", sep)
             .where("predicates <> '' AND objects IS NOT NULL").where(~F.col("predicates").rlike(drop)))
    named = parts.select("subject_id", F.when(F.col("predicates") == title, "title").otherwise(F.col("predicates")).alias("name"),
                         F.col("objects").alias("text"))
    return (PR.collapse_values(named, ["subject_id", "name"], "text", " ")
            .groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("props")))


def _columns(props: DataFrame, key: str, mapping: dict) -> DataFrame:
    return props.select(F.col(key).alias("id"), *[F.try_element_at("props", F.lit(a)).alias(b) for a, b in mapping.items()])


def make_dataset(judged: DataFrame, pages: DataFrame, claims: DataFrame, labels: DataFrame, mapping: dict,
                 variant: str = "full", keep=MATCHES, sep: str = "`", drop: str = "ID") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(left, right, gt)`` of judged descriptions, as ``fit`` and ``evaluate`` take them.

    ``judged``: subject_id, page (the URL of the page the subject was matched
    with), predicates, objects and match.  ``pages``: title, entity.
    ``claims``: entity, property, claim (JSON), ord.  ``labels``: id, label.
    ``mapping`` {name in L: name in R} gives the columns, named as in R;
    ``title`` of L is the entity's label, its claimed title where it has none.

    * left: one row for each entity that a judged page names (also of those
      judged no match); a page that names none gives no row.
    * right: one row for each subject with a description.
    * gt: distinct (id_l, id_r) with a judgement in ``keep`` and both rows,
      with the columns of both sides, suffixed.
    * ``variant``: ``1col`` and ``2col`` keep the first column(s) of the mapping
      and rows without a null, ``full`` keeps all and rows with any value.

    Null subjects, pages and titles match nothing; repeated rows count once."""
    cols = list(mapping.values())
    page = judged.withColumn("title", F.nullif(F.regexp_extract("page", PAGE_RE, 1), F.lit("")))
    known = EN.with_label(page.select("subject_id", "match", "title"), "title",
                          pages.select(F.col("title").alias("id"), F.col("entity").alias("label")), "entity")
    # known, left and right are each needed again by the truth, and made once
    known = known.where("entity IS NOT NULL").select("subject_id", "match", "entity").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    wanted = known.select("entity").distinct()
    claimed = claimed_properties(claims.join(wanted, "entity", "left_semi"), labels, drop)
    named = EN.with_label(wanted.join(claimed, "entity", "left"), "entity", labels, "title")
    props = F.coalesce("props", F.create_map().cast("map<string,string>"))
    titled = F.when(F.col("title").isNull(), props).otherwise(
        F.map_concat(F.map_filter(props, lambda k, _: k != "title"), F.create_map(F.lit("title"), F.col("title"))))
    left = _columns(named.select("entity", titled.alias("props")), "entity", mapping).persist(StorageLevel.MEMORY_AND_DISK)
    right = _columns(described_properties(judged, sep, drop), "subject_id", {c: c for c in cols}).persist(StorageLevel.MEMORY_AND_DISK)
    truth = PR.label_filter(known, "match", list(keep)).select(F.col("entity").alias("id_l"), F.col("subject_id").alias("id_r")).distinct()
    pairs = PR.gt_enrich(truth, left, right, "id")
    used = cols if variant == "full" else cols[:1] if variant == "1col" else cols[:2]
    sides = [c + s for s in ("_l", "_r") for c in used]
    pairs = pairs.select("id_l", "id_r", *sides).na.drop(how="all" if variant == "full" else "any", subset=sides)
    return PR.variant_project(left, "id", cols, variant), PR.variant_project(right, "id", cols, variant), pairs


def make_augmentation(triples: DataFrame, labels: DataFrame, mapping: dict, statement: str = "/entity/statement/",
                      prefer: str = "en") -> DataFrame:
    """Further rows of L from triples, as ``augment`` takes them: the columns of ``mapping``
    {property: column}, distinct, those without a ``title`` left out.

    ``id`` is the entity and ``title (en)`` its label; any other name is a
    property, null where the entity lacks it.  The rules of triples are those
    of ``entities.entity_properties``."""
    if "title" not in mapping.values():
        raise ValueError("the mapping names no title")
    e = EN.with_label(EN.entity_properties(triples, labels, statement, prefer), "entity", labels, "title (en)")
    of = {"id": F.col("entity"), "title (en)": F.col("`title (en)`")}
    return (e.select(*[of.get(a, F.try_element_at("props", F.lit(a))).alias(b) for a, b in mapping.items()])
            .distinct().na.drop(subset=["title"]))
