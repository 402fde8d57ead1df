"""What the operators on copies move between tasks, and how they pick rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import columns, decontaminate, exact_dedup, ngram_join

DOC = "doc_id int, text string"


def moved(spark, frame_of):
    """Bytes that all stages of the work wrote for shuffles."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    frame_of().write.format("noop").mode("overwrite").save()
    return sum(v for k, v in written().items() if k not in before)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.randrange(10**7):x}" for _ in range(300)) for _ in range(1500)]
    texts += [t.replace(" ", "  ", 1) for t in texts[:60]] + [t + " end" for t in texts[100:160]]
    path = str(tmp_path_factory.mktemp("disk") / "docs")
    spark.createDataFrame(list(enumerate(texts)), DOC).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("keep", "most"), [(exact_dedup.deduplicate, 1.3), (lambda d: ngram_join.one_of_each(d, 5, 80), 1.0)])
def test_texts_do_not_travel_for_the_removal(spark, docs, keep, most):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if more rows were gone than a task may hold
    try:
        texts = moved(spark, lambda: docs.repartition(4, "doc_id"))
        assert 0 < moved(spark, lambda: keep(docs)) < most * texts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_full_map_of_removed_rows_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(columns, "_BITS", 64)  # every bit is set: all rows are asked
    rows = [(i, f"text {i % 50}") for i in range(300)] + [(None, "text 1"), (None, "alone")]
    docs = spark.createDataFrame(rows, DOC)
    gone = docs.where((F.col("doc_id") % 3 == 0) | (F.col("text") == "text 1")).select(F.col("doc_id").alias("id"), columns.text_hash(F.col("text")).alias("h"))
    got = [tuple(r) for r in columns.without(docs, gone, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if r[1] != "text 1" and (r[0] is None or r[0] % 3)], key=str)


def plans(spark, frame_of):
    """The number of rows, and the plans of everything that ran for them."""
    store = spark._jsparkSession.sharedState().statusStore()

    def ran():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.executionsList()
        return {e.executionId(): e.physicalPlanDescription() for e in (found.apply(i) for i in range(found.size()))}

    before = ran()
    n = frame_of().count()
    return n, [v for k, v in ran().items() if k not in before]


@pytest.mark.parametrize(
    ("keep", "left"),
    [(exact_dedup.deduplicate, 1560), (lambda d: decontaminate.remove_documents(d, d.where("doc_id < 5").select(F.col("doc_id").alias("item_id"), "text")), 1610)],
    ids=["exact_dedup", "decontaminate"],
)
def test_native_stages_run_no_python(spark, docs, keep, left):
    n, ran = plans(spark, lambda: keep(docs))
    assert n == left and len(ran) > 2
    assert not [p for p in ran if "Python" in p or "InArrow" in p or "InPandas" in p]


def test_every_place_of_the_map_is_looked_up(spark):
    places, chosen = list(range(256)), {0, 1, 62, 63, 64, 65, 127, 128, 191, 254, 255}
    found = np.packbits([p in chosen for p in places], bitorder="little")
    assert columns.is_set(found, np.array(places)).tolist() == [p in chosen for p in places]
    stay, asked = columns.split_by_bits(spark.range(256), F.col("id"), found)
    assert {r.id for r in asked.collect()} == chosen
    assert {r.id for r in stay.collect()} == set(places) - chosen


@pytest.mark.parametrize(("n", "most"), [(0, 8), (1, 32), (300, 300 * 32), (40_000, 2048)])
def test_a_map_is_as_small_as_its_rows_allow(spark, monkeypatch, n, most):
    if n == 40_000:
        monkeypatch.setattr(columns, "_BITS", 1 << 14)
    rows = spark.range(n + 500).withColumn("bit", columns.bit_of(F.col("id")))
    found = columns.bits(F.col("bit"), rows.where(F.col("id") < n))
    assert len(found) <= most and found.any() == (n > 0)
    _, asked = columns.split_by_bits(rows, F.col("bit"), found)
    table = rows.toArrow()
    native = set(asked.toArrow()["id"].to_pylist())
    assert native == set(table["id"].to_numpy()[columns.is_set(found, table["bit"].to_numpy())].tolist())
    assert native >= set(range(n)) and (n == 40_000 or len(native) < n + 25)


def test_buckets_of_hashes_count_every_list(spark):
    rng = random.Random(9)
    lists = [(d * 10**12 - 7, [rng.getrandbits(64) - 2**63 for _ in range(40)] + rng.sample(range(30), 5)) for d in range(80)]
    lists += [(5, [])]
    df = {}
    for _, hs in lists:
        for h in hs:
            df[h] = df.get(h, 0) + 1
    packed = ngram_join._packed(spark.createDataFrame(lists, "doc_id long, list array<long>").repartition(3), 17)
    got = sorted(tuple(r) for r in ngram_join._shared(packed, 4).collect())
    assert got == sorted((d, h, df[h]) for d, hs in lists for h in hs if df[h] > 1)
