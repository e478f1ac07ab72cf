"""What is taken against the targets."""

import pytest

from tessera.llm import mixing

SMALL = (10, 60, 130, 300, 700, 1000)


@pytest.mark.parametrize("hot", [3000, 400000])
def test_small_sources_meet_their_targets(spark, hot):
    rows = [(i, " ".join(f"w{j}" for j in range(n)), f"s{i:02d}") for i, n in enumerate(SMALL)]
    rows += [(100 + i, "word " * 1000, "hot") for i in range(hot // 1000)] + [(900, "a few words of no source", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    taken, target, size = {}, {}, {}
    for doc, r in ((r.doc_id, r) for r in mixing.mix(d).collect()):
        s = rows[[x[0] for x in rows].index(doc)][2]
        taken[s] = taken.get(s, 0) + r.taken
        target[s], size[s] = r.target, r.source_size
    assert len(target) == len(SMALL) + 2
    for s in target:
        assert abs(taken[s] - target[s]) <= -(-size[s] // -(-size[s] // mixing.BLOCK)) and taken[s] <= 3 * size[s], (s, taken[s], target[s])
        if target[s] == 3 * size[s]:
            assert taken[s] == target[s]


def test_blocks_cover_the_stream(spark):
    from pyspark.sql import functions as F

    for size in (1, 10, 127, 128, 129, 300, 1025):
        got = spark.range(size).select(mixing.block_at(F.col("id"), F.lit(size)).alias("b"), "id").withColumn("s", mixing.block_start(F.col("b"), F.lit(size))).withColumn("e", mixing.block_start(F.col("b") + 1, F.lit(size))).orderBy("id").collect()
        assert all(r.s <= r.id < r.e for r in got) and got[0].s == 0 and got[-1].e == size and max(r.e - r.s for r in got) <= mixing.BLOCK
