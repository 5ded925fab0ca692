"""Entity tables from knowledge-base data: claims and triples.

A claim is a JSON value of one of several shapes; ``claim_text`` reads it as a
VARIANT and gives the text of its shape.  ``entity_properties`` makes one map
of properties an entity from (entity, property, value) triples.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAIL_RE = r"[/#](\w+)$"
YEAR_RE = r"^\+?(\d{4})"
# label tables of up to this many rows are broadcast
LABEL_BROADCAST_ROWS = 1_000_000


def iri_tail(iri: Column) -> Column:
    """The word after the last ``/`` or ``#``; null where there is none."""
    return F.nullif(F.regexp_extract(iri, TAIL_RE, 1), F.lit(""))


def with_label(df: DataFrame, key: str, labels: DataFrame, out: str) -> DataFrame:
    """``out``: the label of ``key`` in ``labels`` (id, label), null where it has none.

    An id with several labels gets the smallest.  The label table is counted
    before it is broadcast; a longer one is joined by id, and the rows without
    a key, which are often most, are spread over the tasks of that join."""
    kept = (labels.where(F.col("id").isNotNull()).groupBy(F.col("id").alias(key)).agg(F.min("label").alias(out))
            .persist(StorageLevel.MEMORY_AND_DISK))
    if kept.count() <= LABEL_BROADCAST_ROWS:
        return df.join(F.broadcast(kept), key, "left")
    spread = _unused("spread", [*df.columns, out])
    dealt = df.withColumn(spread, F.when(F.col(f"`{key}`").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)))
    return dealt.join(kept.withColumn(spread, F.lit(0).cast("long")), [key, spread], "left").drop(spread)


def claim_text(df: DataFrame, claim: str, labels: DataFrame, out: str) -> DataFrame:
    """``out``: the text of the JSON in ``claim``, by its shape (first that fits):

    * a string: itself;
    * an item (``entity-type`` is ``item``): the label of its ``id``, the id where it has none;
    * ``time``: its year of four digits; the time as it is where it has none;
    * ``latitude``: ``(latitude, longitude)``;
    * ``text`` (a text in one language): the text;
    * ``unit``: ``amount unit`` with the label of the unit's IRI tail, the tail
      where it has no label, the unit as it is where it has no tail;
    * ``mainsnak``: the value nested in its ``datavalue``;
    * anything else, also numbers and arrays: its JSON text.

    Null and malformed JSON give null.  All other columns are kept."""
    v = F.try_parse_json(F.col(claim))
    at = lambda path: F.try_variant_get(v, path, "string")
    item = at("$['entity-type']") == "item"
    unit = F.coalesce(iri_tail(at("$.unit")), at("$.unit"))
    key = F.when(item, at("$.id")).when(at("$.time").isNull() & at("$.latitude").isNull() & at("$.text").isNull(), unit)
    # names of ours stand beside the caller's columns until the last projection
    mine = {n: _unused(n, df.columns) for n in ("key", "label")}
    j = with_label(df.withColumn(mine["key"], key), mine["key"], labels, mine["label"])
    named = F.coalesce(F.col(mine["label"]), F.col(mine["key"]))
    year = F.nullif(F.regexp_extract(at("$.time"), YEAR_RE, 1), F.lit(""))
    text = (F.when(F.schema_of_variant(v) == "STRING", at("$"))
            .when(item, named)
            .when(at("$.time").isNotNull(), F.coalesce(year, at("$.time")))
            .when(at("$.latitude").isNotNull(), F.concat(F.lit("("), at("$.latitude"), F.lit(", "),
                                                         F.coalesce(at("$.longitude"), F.lit("")), F.lit(")")))
            .when(at("$.text").isNotNull(), at("$.text"))
            .when(at("$.unit").isNotNull(), F.concat_ws(" ", at("$.amount"), named))
            .otherwise(F.coalesce(at("$.mainsnak.datavalue.value"), at("$"))))
    return j.select(*[F.col(f"`{c}`") for c in df.columns if c != out], text.alias(out))


def _unused(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def entity_properties(triples: DataFrame, labels: DataFrame, statement: str = "/entity/statement/",
                      prefer: str = "en") -> DataFrame:
    """``(entity, props: map<string, string>)``, one row an entity.

    ``triples``: entity, property, value, kind (``uri`` or ``literal``), lang
    (of a literal, may be null) and ord (long, the order of the rows).

    * The entity and the property are the tails of their IRIs; rows without
      either tail are dropped.  A property that is an id (``P12``) is called by
      its label, by the id where it has none.
    * Values within the ``statement`` namespace are dropped.  A ``uri`` whose
      tail is an item (``Q12``) becomes its label and is dropped where it has
      none; any other stays as it is.
    * Of several values the first literal in the language ``prefer`` counts,
      else the last value.  Values of equal ord are taken by size.

    An entity's map holds a value for each property it has, whatever its name;
    an entity of which every row is dropped has no row.  Null values are
    dropped."""
    t = (triples.select(iri_tail(F.col("entity")).alias("entity"), iri_tail(F.col("property")).alias("pid"), "value", "kind", "lang", "ord")
         .where(F.col("entity").isNotNull() & F.col("pid").isNotNull() & F.col("value").isNotNull()
                & ~F.contains("value", F.lit(statement))))
    t = t.withColumn("vid", F.when(F.col("kind") == "uri", F.nullif(F.regexp_extract("value", r"/(Q\d+)$", 1), F.lit(""))))
    t = with_label(with_label(t, "pid", labels, "plabel"), "vid", labels, "vlabel")
    name = F.when(F.col("pid").rlike(r"^P\d+"), F.coalesce("plabel", "pid")).otherwise(F.col("pid"))
    best = F.coalesce((F.col("kind") == "literal") & (F.col("lang") == prefer), F.lit(False))
    rank = F.struct(best, F.when(best, -F.col("ord")).otherwise(F.col("ord")), "text")
    return (t.withColumn("text", F.when(F.col("vid").isNull(), F.col("value")).otherwise(F.col("vlabel"))).where("text IS NOT NULL")
            .groupBy("entity", name.alias("name")).agg(F.max_by("text", rank).alias("text"))
            .groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("props")))


def property_columns(entities: DataFrame, names: list[str]) -> DataFrame:
    """One column for each named property, null where an entity lacks it."""
    return entities.select("entity", *[F.try_element_at("props", F.lit(n)).alias(n) for n in names])
