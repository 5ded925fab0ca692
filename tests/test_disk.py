"""What the fuzzy join keeps on disk: cuts of the lineage in columns, records that travel in blocks."""

import os
import random

from pyspark.sql import functions as F

from fuzzyspark.operators import blocking as B
from fuzzyspark.operators import cells as C
from fuzzyspark.operators import rules as NR
from fuzzyspark.operators.pairs import PairSpace
from fuzzyspark.operators.space import from_name
from fuzzyspark.session import checkpoint_dir, reliable_checkpoint, scratch


def folder_bytes(path):
    path = path.removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(path) for x in names)


def test_a_cut_takes_less_than_its_rows(spark):
    df = spark.range(20_000, numPartitions=2).select(F.lit("LR").alias("side"), (F.col("id") % 150).alias("id_l"), F.col("id").alias("id_r"),
                                                     *[F.round((F.col("id") % 90) / 90 + i, 9).alias(f"d{i}_0") for i in range(6)])
    before = folder_bytes(checkpoint_dir(spark))
    with scratch():
        cut = reliable_checkpoint(df)
        assert cut.dtypes == df.dtypes
        assert cut.count() == 20_000 and cut.exceptAll(df).isEmpty() and df.exceptAll(cut).isEmpty()
        # a row of nine fields is at least 80 bytes in a checkpoint of rows
        assert 0 < folder_bytes(checkpoint_dir(spark)) - before < 20 * 20_000
    assert folder_bytes(checkpoint_dir(spark)) == before


def test_scratch_drops_only_its_own_tables(spark):
    kept = reliable_checkpoint(spark.range(3).toDF("id"))
    with scratch():
        inner = reliable_checkpoint(spark.range(5).toDF("id"))
        assert inner.count() == 5
    assert kept.count() == 3


def test_cells_get_blocks_and_few_rows(spark):
    post = spark.range(3_000).select(F.col("id").alias("id_l"), F.explode(F.array(*[F.concat(F.lit(f"t{i}-"), F.col("id") % (i + 2)) for i in range(4)])).alias("token"),
                                     F.lit(0.5).alias("w"))
    rtok = post.where("id_l % 2 = 0").select((F.col("id_l") + 10_000).alias("id_r"), "token")
    assert B._grid(post, rtok, B.SALT_ROWS) == (1, 2), "records of R are copied once, those of L to each column"
    whole = post.groupBy("id_l").agg(F.collect_list("token").alias("tokens"), F.collect_list("w").alias("ws"))
    sent = (whole.select(F.lit(0).alias("part"), F.col("id_l").alias("id"), "tokens", "ws", F.lit(None).cast("double").alias("least"))
            .coalesce(1).mapInArrow(B._blocks, "part int, block binary").collect())
    assert len(sent) == 1 and len(sent[0]["block"]) < 3_000 * 4 * 10, "at most ten bytes a token with its weight and id"
    best = B.top_k(B.pair_sums(rtok, post, 5).select("id_l", "id_r", F.col("w").alias("score")), 5)
    want = B.top_k(rtok.join(post, "token").groupBy("id_l", "id_r").agg(F.sum("w").alias("score")), 5)
    assert best.exceptAll(want).isEmpty() and want.exceptAll(best).isEmpty()


def test_records_are_copied_to_few_rows_of_cells(spark):
    """Cells of 4,096 records squared copied each of 150,000 records seven times."""
    assert -(-(150_000 / C.CELL_RECORDS) ** 0.5 // 1) <= 4


def test_pairs_are_found_once_for_the_rules(spark):
    """The plan of the pairs stood twice in that of the pruned ones, so blocking ran twice."""
    norm = spark.createDataFrame([(1, "red car"), (2, "blue car"), (3, "red boat"), (9, "blue boat")], "id long, value string")
    pairs = B.block_normalized(norm, norm, 4, 3)
    sets = NR.word_sets(norm)
    rules = spark.createDataFrame([("red", "blue"), ("blue", "red")], "a string, b string")
    kept = NR.apply(pairs, sets, sets, rules)
    assert "FlatMapGroupsInArrow" not in kept._jdf.queryExecution().optimizedPlan().toString()
    colour = {1: "red", 2: "blue", 3: "red", 9: "blue"}
    want = {(r["id_l"], r["id_r"]) for r in pairs.collect() if colour[r["id_l"]] == colour[r["id_r"]]}
    assert {tuple(r) for r in kept.collect()} == want and want


def test_blocks_hold_the_factors_of_weights_once(spark):
    """A weight is count/len times ln(N/(df+1)): nearly every one differs, and each stood with eight bytes in the blocks."""
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(900)]
    norm = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randint(2, 9)))) for i in range(1_500)], "id long, value string").cache()
    post = B.left_postings(norm, 1_500).cache()
    assert post.where("w <> tf * idf").isEmpty()
    sizes, sums = [], []
    for p in (post, post.drop("tf", "idf")):
        sums.append(B.pair_sums(B.right_tokens(norm), p, 5))
        lists = ["collect_list(token) AS tokens"] + (["collect_list(tf) AS ws", "collect_list(idf) AS idf"] if "tf" in p.columns else ["collect_list(w) AS ws"])
        whole = p.groupBy("id_l").agg(*[F.expr(x) for x in lists])
        sent = whole.select(F.lit(0).alias("part"), F.col("id_l").alias("id"), *whole.columns[1:], F.lit(None).cast("double").alias("least"))
        sizes.append(sum(len(r["block"]) for r in sent.coalesce(1).mapInArrow(B._blocks, "part int, block binary").collect()))
    assert sizes[0] < 0.75 * sizes[1]
    assert sums[0].exceptAll(sums[1]).isEmpty() and sums[1].exceptAll(sums[0]).isEmpty(), "the same sums to the last bit"
    assert B.pair_sums(B.right_tokens(norm), post.drop("w"), 5).exceptAll(sums[0]).isEmpty()


def test_distances_are_cut_once_and_as_whole_numbers(spark):
    class Gap:
        name = "gap"

        def distance(self, left, right):
            return F.abs(F.length(left) - F.length(right)) / 7

    left = spark.createDataFrame([(1, "red car one"), (2, "blue car"), (3, None), (4, "!!")], "id long, v string")
    right = spark.createDataFrame([(10, "red car"), (11, ""), (12, "blue cars two"), (13, None)], "id long, v string")
    jfs = [from_name("lower_threeGram_idfWeight_cosineDistance"), from_name("lower_None_None_jaroDistance"), from_name("lower_None_None_editDistance"), Gap()]
    pairs = lambda l, r: l.select(F.col("id").alias("id_l")).crossJoin(r.select(F.col("id").alias("id_r")))
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    ps = PairSpace(left, right, "id", ["v"], jfs, stem=False)
    made = []

    def cut(df):
        made.append(reliable_checkpoint(df))
        return made[-1]

    got = ps.pair_distances(pairs(left, left), pairs(left, right), cut=cut)
    assert not ps._persisted, "no second copy of the distances"
    assert [t for c, t in made[0].dtypes if c.startswith("d")] == ["bigint"] * 3 + ["double"]
    raw = rows(ps.pair_distances(pairs(left, left), pairs(left, right), fill=False))
    assert len(raw) == 32 and any("None" in r for r in raw)
    plain = ps.pair_distances(pairs(left, left), pairs(left, right))
    assert rows(got) == rows(plain) and got.dtypes == plain.dtypes
    given = {jf.name: {"v": 0.25} for jf in jfs}
    assert (rows(ps.pair_distances(pairs(left, left), pairs(left, right), null_fill=given, cut=cut))
            == rows(ps.pair_distances(pairs(left, left), pairs(left, right), null_fill=given)))
