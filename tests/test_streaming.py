from pyspark.sql import functions as F

from loomspark.functions.text import fingerprint_native
from loomspark.streaming import ingest


def test_stream_counts_equal_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.accepted_stream(ingest.documents(spark, str(tmp_path / "in"), docs.schema), 1, 100_000, 0.3)
    counts = ingest.split_counts(stream.withColumn("source", F.lit("all")))
    q = ingest.start(counts, "counts", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {r.split: r.documents for r in spark.sql("select * from counts").collect()}
    want = docs.where("text <> ''").select(fingerprint_native(F.col("text"), 0.3).alias("f")).select("f.*").distinct().groupBy("split").count().collect()
    assert got == {r["split"]: r["count"] for r in want}


def test_upserts(spark):
    points = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 4.0)], "candidate_id string, tokens long, nll double")
    batch = spark.createDataFrame([("a", 2, 3.0, 0), ("a", 2, 2.0, 1), ("a", 4, 1.0, 2)], "candidate_id string, tokens long, nll double, seq long")
    assert sorted(map(tuple, ingest.upsert_points(points, batch).collect())) == [("a", 1, 5.0), ("a", 2, 2.0), ("a", 4, 1.0)]
