"""More queries of the engine's operators, and the same in SQL.

the operator itself.  Tables that don't hold an operator's own input stand in for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import queries as base
from .config import DEDUP_POLICY, PrepSettings, Source, digest, disk_needed, quotas
from .functions import text as tx
from .functions.tokens import ByteTokenizer
from .operators import curves, genome, pack, ranks, schedule
from .plans import search
from .queries import PHASES, SHARD, STRIDE, query, table
from .sources import documents as src
from .streaming import ingest

_NORM, _PICKS, _PHASES, _CURVES, _RECORDS = base._NORM, base._PICKS_SQL, base._PHASES_SQL, base._CURVES_SQL, base._RECORDS_SQL
_WORDS = "text <> ''"


# --- documents ------------------------------------------------------------------------------------


def _spec(**more) -> Source:
    return Source("documents", "local", "", "text", **more)


@query("flt_2_length_bounds", f"SELECT doc_id AS row, length(text) AS chars FROM documents WHERE {_WORDS} AND length(text) BETWEEN 500 AND 3000")
def length_bounds(spark: SparkSession, sf: str) -> DataFrame:
    got = src.in_memory(table(spark, sf, "documents"), _spec(), "doc_id", 500, 3_000)
    return got.select("row", F.length("content").cast("long").alias("chars"))


@query("flt_3_language", f"SELECT doc_id AS row FROM documents WHERE {_WORDS} AND doc_id % 9 <> 0 AND lang = 'de'")
def language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("lang", F.when(F.col("doc_id") % 9 != 0, F.col("lang")))
    return src.in_memory(docs, _spec(language_column="lang", language="de"), "doc_id", 0, 10**9).select("row")


@query("flt_5_numeric_scores", "SELECT o_orderkey AS row, o_totalprice AS score FROM orders WHERE o_orderkey % 3 <> 0 AND o_totalprice >= 100000")
def numeric_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that are no number raise, but only in rows that the other filters leave."""
    orders = table(spark, sf, "orders").withColumn("raw", F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")))
    orders = orders.withColumn("text", F.when(F.col("o_orderkey") % 3 != 0, "kept"))
    got = src.in_memory(orders, _spec(score_column="raw", min_score=100_000), "o_orderkey", 0, 10)
    return got.select("row", "score")


@query("fn_10_metadata_values", "SELECT o_orderkey AS row, CAST(o_custkey AS VARCHAR) AS customer, CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'False' END AS even, o_orderpriority AS bytes FROM orders")
def metadata_values(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumns({"text": F.lit("x"), "even": F.col("o_custkey") % 2 == 0, "raw": F.col("o_orderpriority").cast("binary")})
    got = src.in_memory(orders, _spec(metadata_columns={"customer": "o_custkey", "even": "even", "bytes": "raw"}), "o_orderkey", 0, 10)
    return got.select("row", *[F.col("metadata")[k].alias(k) for k in ("customer", "even", "bytes")])


@query("fn_24_metadata_maps", "SELECT o_orderkey AS row, CASE WHEN o_custkey % 2 = 0 THEN 'a,status' ELSE 'status' END AS keys, CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM orders")
def metadata_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Keys in order, nulls left out, columns that aren't there ignored."""
    orders = table(spark, sf, "orders").withColumns({"text": F.lit("x"), "some": F.when(F.col("o_custkey") % 2 == 0, "yes")})
    got = src.in_memory(orders, _spec(metadata_columns={"status": "o_orderstatus", "a": "some", "lost": "nowhere"}), "o_orderkey", 0, 10)
    return got.select("row", F.array_join(F.map_keys("metadata"), ",").alias("keys"), F.size("metadata").alias("n"))


@query("joi_4_metadata_aliases", "SELECT p_partkey AS row, p_brand AS maker, CAST(p_size AS VARCHAR) AS measure FROM part WHERE length(p_name) BETWEEN 5 AND 200")
def metadata_aliases(spark: SparkSession, sf: str) -> DataFrame:
    spec = Source("part", "local", "", "p_name", metadata_columns={"maker": "p_brand", "measure": "p_size"})
    got = src.in_memory(table(spark, sf, "part"), spec, "p_partkey", 5, 200)
    return got.select("row", F.col("metadata")["maker"].alias("maker"), F.col("metadata")["measure"].alias("measure"))


@query("src_8_in_memory", "SELECT 'memory' AS file, 0 AS file_ord, doc_id AS row, sha256(text) AS content FROM documents WHERE text <> ''")
def in_memory(spark: SparkSession, sf: str) -> DataFrame:
    return src.in_memory(table(spark, sf, "documents"), _spec(), "doc_id", 0, 10**9).select("file", "file_ord", "row", F.sha2("content", 256).alias("content"))


@query("fn_2_byte_tokens", "SELECT doc_id, strlen(coalesce(text, '')) + 2 AS n_tokens FROM documents")
def byte_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ByteTokenizer.length_column(F.coalesce("text", F.lit(""))).alias("n_tokens"))


@query("set_1_distinct_files", "SELECT DISTINCT n_name || '.parquet' AS path FROM nation")
def distinct_files(spark: SparkSession, sf: str) -> DataFrame:
    names = [r[0] + end for r in table(spark, sf, "nation").select("n_name").collect() for end in (".parquet", ".json", ".parquet")]  # 25 nations
    return spark.createDataFrame([(p,) for p in src.ordered(_spec(), names, 7).paths], "path string")


# --- acceptance -----------------------------------------------------------------------------------

_ONE = {"train": 300_000, "val": 100_000}
_ACCEPT_ONE = f"""c AS (SELECT doc_id AS row, {_NORM} AS body, {base._SPLIT_SQL} AS split, CAST(strlen(text) AS BIGINT) + 2 AS n FROM documents WHERE text <> '' AND length(text) <= 100000 AND {{keep}}),
    f AS (SELECT min(row) AS row FROM c GROUP BY body),
    o AS (SELECT row, split, n, CAST(coalesce(sum(n) OVER (PARTITION BY split ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_token FROM c JOIN f USING (row)),
    a AS (SELECT row, split, n, start_token, start_token + n AS end_token FROM o WHERE start_token < CASE split WHEN 'val' THEN {_ONE["val"]} ELSE {_ONE["train"]} END)"""


@query("flt_6_first_of_a_digest", f"SELECT min(doc_id) AS row, count(*) - 1 AS skipped FROM (SELECT doc_id, {_NORM} AS body FROM documents WHERE text <> '' AND length(text) <= 100000) GROUP BY body")
def first_of_a_digest(spark: SparkSession, sf: str) -> DataFrame:
    docs = base._candidates(spark, sf)
    copies = docs.groupBy("dedup_hash").agg((F.count(F.lit(1)) - 1).alias("skipped"))
    return pack.first_occurrences(docs).join(copies, "dedup_hash").select("row", "skipped")


@query("flt_7_full_splits", f"WITH {_ACCEPT_ONE.format(keep='true')} SELECT row, split, start_token, end_token FROM a")
def full_splits(spark: SparkSession, sf: str) -> DataFrame:
    return pack.accept(base._candidates(spark, sf), _ONE).select("row", "split", "start_token", "end_token")


@query("joi_1_accepted_digests", f"WITH {_ACCEPT_ONE.format(keep=f'{_NORM} NOT IN (SELECT {_NORM} FROM documents WHERE doc_id % 5 = 0)')} SELECT row, split, start_token FROM a")
def accepted_digests(spark: SparkSession, sf: str) -> DataFrame:
    taken = table(spark, sf, "documents").where("doc_id % 5 = 0").select(tx.fingerprint_native(F.col("text"), base.FRACTION)["dedup_hash"].alias("dedup_hash"))
    return pack.accept(base._candidates(spark, sf), _ONE, taken).select("row", "split", "start_token")


@query("flt_8_filled_splits", f"""WITH {_ACCEPT_ONE.format(keep='true')} SELECT row, split, start_token + 250000 AS start_token FROM a WHERE split = 'train' AND start_token + 250000 < {_ONE["train"]}""")
def filled_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier files have filled one split and most of the other."""
    return pack.accept(base._candidates(spark, sf), _ONE, None, {"train": 250_000, "val": 100_000}).select("row", "split", "start_token")


@query(
    "agg_3_budget_report",
    f"""{base._ACCEPT_SQL}, t AS (SELECT source_id, split, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS documents FROM {base._LAST} GROUP BY ALL),
        w AS (SELECT DISTINCT source AS source_id, s.split, CASE s.split WHEN 'val' THEN {base.VAL} ELSE {base.TRAIN} END AS target FROM documents, (VALUES ('train'), ('val')) s(split))
        SELECT source_id, split, coalesce(tokens, 0) AS tokens, coalesce(documents, 0) AS documents, coalesce(tokens, 0) - target AS overshoot, coalesce(tokens, 0) - target + 1000 AS reserve, coalesce(tokens, 0) >= target AS complete
        FROM w LEFT JOIN t USING (source_id, split)""",
)
def budget_report(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "documents").select(F.col("source").alias("source_id")).distinct().select("source_id", F.explode(F.array(F.lit("train"), F.lit("val"))).alias("split"))
    targets = wanted.withColumn("target", F.when(F.col("split") == "val", base.VAL).otherwise(base.TRAIN).cast("long")).withColumn("requested", F.col("target") - 1_000)
    return pack.budget_report(pack.split_totals(base._accepted(spark, sf)), targets).select("source_id", "split", "tokens", "documents", "overshoot", "reserve", "complete")


@query(
    "win_11_file_shards",
    f"""WITH d AS (SELECT source AS source_id, doc_id % 3 AS f, doc_id AS row, CAST(strlen(coalesce(text, '')) + 2 AS BIGINT) AS n FROM documents),
        p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source_id ORDER BY f, row) - n AS BIGINT) AS a, CAST(sum(n) OVER (PARTITION BY source_id, f ORDER BY row) - n AS BIGINT) AS i FROM d),
        e AS (SELECT *, a - i AS opened, unnest(range(i // {SHARD}, (i + n - 1) // {SHARD} + 1)) AS k FROM p),
        g AS (SELECT source_id, f, row, k, greatest(a, opened + k * {SHARD}) AS from_token, least(a + n, opened + (k + 1) * {SHARD}) AS to_token FROM e)
        SELECT source_id, row, dense_rank() OVER (PARTITION BY source_id ORDER BY f, k) - 1 AS shard, from_token, to_token FROM g""",
)
def file_shards(spark: SparkSession, sf: str) -> DataFrame:
    """The end of a file closes the open shard."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("source_id"), F.lit("train").alias("split"), (F.col("doc_id") % 3).cast("int").alias("file_ord"), F.col("doc_id").alias("row"), ByteTokenizer.length_column(F.coalesce("text", F.lit(""))).alias("n_tokens"))
    placed = pack.running_offsets(docs, "n_tokens", ("source_id", "split")).withColumnRenamed("offset", "start_token").withColumn("end_token", F.col("start_token") + F.col("n_tokens"))
    return pack.shard_segments(placed, SHARD).select("source_id", "row", F.col("shard").cast("long").alias("shard"), "from_token", "to_token")


# --- mixture, schedule ----------------------------------------------------------------------------


def _manifest(tokens: int = 2_000_000) -> dict:
    split = {"tokens": tokens, "shards": [{"path": f"shard-{k}", "tokens": tokens // 4} for k in range(4)]}
    return {
        "requested_train_tokens": PHASES[-1].end,
        "mixture": {"phases": [{"end_tokens": p.end, "weights": dict(p.weights)} for p in PHASES]},
        "sources": [{"id": s, "splits": {"train": split, "val": split}} for s in PHASES[0].weights],
    }


@query("win_3_phase_starts", f"WITH {_PHASES} SELECT phase, CAST(start_tokens AS BIGINT) AS start_tokens, CAST(end_tokens AS BIGINT) AS end_tokens, source_id, weight FROM p")
def phase_starts(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.phase_table(spark, PHASES).select("phase", "start_tokens", "end_tokens", "source_id", "weight")


_CYCLE_STEPS = """c AS (SELECT phase, max(weight) FILTER (source_id = 'a') AS a, max(weight) FILTER (source_id = 'b') AS b, max(weight) FILTER (source_id = 'c') AS c FROM p GROUP BY phase),
    r AS (SELECT phase, 0 AS slot, a AS x, b AS y, c AS z, a, b, c FROM c
        UNION ALL SELECT phase, slot + 1, x + a - CASE WHEN x >= y AND x >= z THEN 100 ELSE 0 END, y + b - CASE WHEN y > x AND y >= z THEN 100 ELSE 0 END, z + c - CASE WHEN z > x AND z > y THEN 100 ELSE 0 END, a, b, c FROM r WHERE slot < 99),
    t AS (SELECT phase, slot, CASE WHEN x >= y AND x >= z THEN 'a' WHEN y >= z THEN 'b' ELSE 'c' END AS source_id FROM r)"""


@query("sch_1_smooth_cycles", f"WITH RECURSIVE {_PHASES}, {_CYCLE_STEPS} SELECT phase, slot, source_id FROM t")
def smooth_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.cycle_table(spark, PHASES)


@query("set_7_cycle_counts", f"WITH {_PHASES} SELECT phase, source_id, CAST(weight AS BIGINT) AS picks FROM p")
def cycle_counts(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.cycle_table(spark, PHASES).groupBy("phase", "source_id").agg(F.count(F.lit(1)).alias("picks"))


_CONTEXT = f"WITH b AS (SELECT range AS batch, range * {STRIDE} AS o FROM range(1200)), q AS (SELECT batch, o, CASE WHEN o >= 300000 THEN 2 WHEN o >= 200000 THEN 1 ELSE 0 END AS phase FROM b)"


@query("sch_3_phase_context", f"{_CONTEXT} SELECT batch, phase, batch - [0, 391, 586][phase + 1] AS phase_batch FROM q")
def phase_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.range(1_200).select(F.col("id").alias("batch"), schedule.phase_of(F.col("id") * STRIDE, PHASES).alias("phase"))
    return rows.withColumn("phase_batch", F.col("batch") - schedule.first_batch(F.col("phase"), PHASES, STRIDE))


@query("joi_5_phase_intervals", f"WITH {_PHASES}, b AS (SELECT range * 1000 AS o FROM range(500)), k AS (SELECT DISTINCT phase, end_tokens FROM p) SELECT o AS \"offset\", CAST(count(k.phase) AS INTEGER) AS phase FROM b LEFT JOIN k ON o >= k.end_tokens AND k.phase < 2 GROUP BY o")
def phase_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(500).select((F.col("id") * 1_000).alias("offset"), schedule.phase_of(F.col("id") * 1_000, PHASES).alias("phase"))


@query("fn_13_first_batches", "SELECT range + 1 AS stride, (200000 + range) // (range + 1) AS second, (300000 + range) // (range + 1) AS third FROM range(700)")
def first_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, *(int(x) for x in schedule.Rota.of_phases(PHASES, n).starts[1:])) for n in range(1, 701)]
    return spark.createDataFrame(rows, "stride long, second long, third long")


@query("agg_8_picks_by_source", f"{_PICKS} SELECT source_id, count(*) AS picks FROM s GROUP BY source_id")
def picks_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.schedule(spark, PHASES, STRIDE, 1_000).groupBy("source_id").agg(F.count(F.lit(1)).alias("picks"))


@query("fn_14_picks_before", f"{_PICKS} SELECT source_id, count(*) FILTER (batch < 137) AS early, count(*) FILTER (batch < 900) AS late FROM s GROUP BY source_id")
def picks_before(spark: SparkSession, sf: str) -> DataFrame:
    rota = schedule.Rota.of_phases(PHASES, STRIDE)
    early, late = rota.before(137), rota.before(900)
    return spark.createDataFrame([(s, early[s], late[s]) for s in rota.names], "source_id string, early long, late long")


@query("agg_9_demand", f"{_PICKS} SELECT source_id, count(*) * {STRIDE} + 1 AS needed FROM s WHERE batch < (400000 + {STRIDE} - 1) // {STRIDE} GROUP BY source_id")
def demand(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(schedule.demand(_manifest(), STRIDE).items()), "source_id string, needed long")


@query("sch_7_capacity", f"{_PICKS} SELECT tokens, bool_and(needed <= tokens) AS enough FROM (SELECT count(*) * {STRIDE} + 1 AS needed FROM s WHERE batch < 782 GROUP BY source_id), (SELECT 100000 + range * 10000 AS tokens FROM range(10)) GROUP BY tokens")
def capacity(spark: SparkSession, sf: str) -> DataFrame:
    def enough(tokens: int) -> bool:
        try:
            schedule.check_capacity(_manifest(tokens), STRIDE)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(n, enough(n)) for n in range(100_000, 200_000, 10_000)], "tokens long, enough boolean")


def _cursors(spark: SparkSession, split: str, batches: range) -> DataFrame:
    rows = []
    for b in batches:
        c = schedule.cursor(_manifest(), split, b * STRIDE, STRIDE // 4, 2, 2)
        rows += [(b, str(c["phase"]), c["selected_source"], s, c["source_offsets"][s], c["source_epochs"][s]) for s in c["source_offsets"]]
    return spark.createDataFrame(rows, "batch long, phase string, selected string, source_id string, source_offset long, epoch long")


@query(
    "sch_6_training_cursors",
    f"""{_PICKS}, k AS (SELECT DISTINCT source_id FROM p) SELECT b.batch, CAST(b.phase AS VARCHAR) AS phase, b.source_id AS selected, k.source_id, count(s.batch) * {STRIDE} AS source_offset, 0::BIGINT AS epoch
        FROM s b CROSS JOIN k LEFT JOIN s ON s.source_id = k.source_id AND s.batch < b.batch WHERE b.batch % 37 = 5 AND b.batch < 780 GROUP BY ALL""",
)
def training_cursors(spark: SparkSession, sf: str) -> DataFrame:
    return _cursors(spark, "train", range(5, 780, 37))


@query(
    "sch_12_validation_cursors",
    f"""WITH b AS (SELECT range * 997 AS batch FROM range(30)), k AS (SELECT unnest([0, 1, 2]) AS i), n AS (SELECT batch, i, (batch - i + 2) // 3 AS n, 1999999 // {STRIDE} AS whole FROM b, k)
        SELECT batch, 'validation' AS phase, ['a', 'b', 'c'][batch % 3 + 1] AS selected, ['a', 'b', 'c'][i + 1] AS source_id, n % whole * {STRIDE} AS source_offset, n // whole AS epoch FROM n""",
)
def validation_cursors(spark: SparkSession, sf: str) -> DataFrame:
    return _cursors(spark, "val", range(0, 30 * 997, 997))


@query("joi_7_shard_of_offset", "SELECT range * 777 AS source_offset, CAST(least(range * 777 // 500000, 3) AS INTEGER) AS shard FROM range(3000)")
def shard_of_offset(spark: SparkSession, sf: str) -> DataFrame:
    shards = _manifest()["sources"][0]["splits"]["train"]["shards"]
    return spark.createDataFrame([(k * 777, schedule.shard_of(shards, k * 777)["index"]) for k in range(3_000)], "source_offset long, shard int")


@query(
    "sch_8_batch_windows",
    """WITH w AS (SELECT b.range AS batch, r.range AS rank, x.range AS row, b.range * 120 + r.range * 60 + x.range * 20 AS a FROM range(50) b, range(2) r, range(3) x)
       SELECT batch, CAST(rank AS INTEGER) AS rank, CAST(row AS INTEGER) AS row, array_to_string(list_transform(range(a, a + 20), lambda i: i * 7 % 1009), ',') AS inputs, array_to_string(list_transform(range(a + 1, a + 21), lambda i: i * 7 % 1009), ',') AS targets FROM w""",
)
def batch_windows(spark: SparkSession, sf: str) -> DataFrame:
    runs = spark.range(100).select(F.lit("a").alias("source_id"), F.lit("train").alias("split"), (F.col("id") * 77).alias("start_token"), F.transform(F.sequence(F.col("id") * 77, F.col("id") * 77 + 76), lambda i: (i * 7 % 1009).cast("int")).alias("tokens"))
    picks = spark.range(50).select(F.col("id").alias("batch"), F.lit("a").alias("source_id"), (F.col("id") * 120).alias("source_offset"))
    got = schedule.batch_windows(picks, runs, 20, 3, 2)
    return got.select("batch", "rank", "row", F.array_join("inputs", ",").alias("inputs"), F.array_join("targets", ",").alias("targets"))


def _settings() -> PrepSettings:
    return PrepSettings.parse({
        "sources": [{"id": s, "repo": f"local/{s}", "tree_path": "", "content_column": "text"} for s in PHASES[0].weights],
        "mixture": _manifest()["mixture"], "requested_train_tokens": PHASES[-1].end, "validation_tokens_per_source": 5_000, "validation_fraction": 0.1,
        "filtering": {"min_chars": 1, "max_chars": 1_000}, "dedup": dict(DEDUP_POLICY), "shards": {"tokens": 10_000, "maximum_loader_microbatch_tokens": 256},
    })


@query("joi_2_source_quotas", f"WITH {_PHASES} SELECT source_id, CAST(sum((end_tokens - start_tokens) * weight // 100) AS BIGINT) AS quota, CAST(sum((end_tokens - start_tokens) * weight // 100) + 4 * 256 AS BIGINT) AS target FROM p GROUP BY source_id")
def source_quotas(spark: SparkSession, sf: str) -> DataFrame:
    s = _settings()
    return spark.createDataFrame([(k, q, s.target(k, "train")) for k, q in quotas(s.phases).items()], "source_id string, quota long, target long")


@query("agg_7_capacity_estimate", "SELECT 2 * (400000 + 3 * (4 * 256 + 5000))::BIGINT AS packed, 20 * 1024 * 1024 * 1024::BIGINT AS raw_file, 5 * 1024 * 1024 * 1024::BIGINT AS index, 2 * (400000 + 3 * (4 * 256 + 5000)) + 25 * 1024 * 1024 * 1024::BIGINT AS total")
def capacity_estimate(spark: SparkSession, sf: str) -> DataFrame:
    need = disk_needed(_settings())
    return spark.createDataFrame([tuple(need[k] for k in ("packed", "raw_file", "index", "total"))], "packed long, raw_file long, index long, total long")


@query("sch_13_reserve", "SELECT (3 + 1) * 256::BIGINT AS reserve")
def reserve(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(_settings().reserve,)], "reserve long")


@query("sch_11_validation_slices", "SELECT * FROM (VALUES ('monitor', 0::BIGINT, 1000::BIGINT), ('final', 1500::BIGINT, 4000::BIGINT)) v(name, first, tokens)")
def validation_slices(spark: SparkSession, sf: str) -> DataFrame:
    got = search.validation_slices({"monitor_offset": 0, "monitor_tokens": 1_000, "final_offset": 1_500, "final_tokens": 4_000})
    return spark.createDataFrame([(k, *v) for k, v in got.items()], "name string, first long, tokens long")


@query("fn_12_canonical_digests", """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}') AS digest FROM nation""")
def canonical_digests(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name").collect()  # 25 nations
    return spark.createDataFrame([(r.n_nationkey, digest({"name": r.n_name, "key": r.n_nationkey})) for r in rows], "n_nationkey int, digest string")


# --- study analytics ------------------------------------------------------------------------------


def _order_curves(spark: SparkSession, sf: str) -> DataFrame:
    point = F.struct(F.col("o_orderkey").cast("long").alias("tokens"), F.col("o_totalprice").cast("double").alias("nll"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(point).alias("c"))


@query("win_5_last_points", "SELECT o_custkey, o_orderkey AS tokens, o_totalprice AS nll FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n >= 3 AND k <= 3")
def last_points(spark: SparkSession, sf: str) -> DataFrame:
    return _order_curves(spark, sf).select("o_custkey", F.explode(curves.last_points(F.col("c"))).alias("p")).select("o_custkey", "p.*")


@query("flt_13_curve_until", "SELECT o_custkey, o_orderkey AS tokens FROM orders WHERE o_orderkey <= 5000")
def curve_until(spark: SparkSession, sf: str) -> DataFrame:
    return _order_curves(spark, sf).select("o_custkey", F.explode(curves.curve_until(F.col("c"), F.lit(5_000))).alias("p")).select("o_custkey", "p.tokens")


@query("flt_15_nested_metrics", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS price, CAST(NULL AS DOUBLE) AS lost FROM part")
def nested_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Not a number, or not there: null."""
    part = table(spark, sf, "part").withColumn("m", F.struct(F.struct(F.when(F.col("p_size") % 3 == 0, float("nan")).otherwise(F.col("p_retailprice")).alias("price")).alias("cost")))
    return part.select("p_partkey", curves.metric(part, "m.cost.price").alias("price"), curves.metric(part, "m.other.price").alias("lost"))


@query("agg_12_median_slope", f"WITH {_CURVES} SELECT round(median(measured_slope), 7) + 0.0::DOUBLE AS median_slope FROM reg")
def median_slope(spark: SparkSession, sf: str) -> DataFrame:
    live = base._curves(spark, sf).where("status <> 'failed'")
    told = curves.forecasts(curves.regressions(live), base._HORIZON)
    return told.select((F.round("median_slope", 7) + F.lit(0.0)).alias("median_slope")).distinct()


@query("joi_11_current_ranks", f"WITH {_CURVES} SELECT candidate_id, current_nll, (rank() OVER (ORDER BY current_nll) - 1 + (count(*) OVER (PARTITION BY current_nll) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1) AS current_rank FROM reg")
def current_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return curves.quality_scores(base._curves(spark, sf), base._HORIZON).select("candidate_id", "current_nll", "current_rank")


_PERCENTILES = "list_sort(list({v}))[CAST(round_even((count(*) - 1) * {f}::DOUBLE, 0) AS INTEGER) + 1]"


@query("agg_15_distributions", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_PERCENTILES.format(v='l_quantity', f=0.5)} AS p50, {_PERCENTILES.format(v='l_quantity', f=0.95)} AS p95 FROM lineitem GROUP BY ALL")
def distributions(spark: SparkSession, sf: str) -> DataFrame:
    got = ranks.nearest_rank(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", {"p50": 0.5, "p95": 0.95})
    return got.withColumn("n", F.col("n").cast("long"))


@query("agg_16_step_report", f"SELECT l_returnflag, round(avg(l_quantity), 9) AS mean_seconds, median(l_quantity) AS median_seconds, {_PERCENTILES.format(v='l_quantity', f=0.9)} AS p90_seconds, round(4096 / avg(l_quantity), 6) AS tokens_per_second FROM lineitem GROUP BY l_returnflag")
def step_report(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("seconds"))
    got = curves.step_report(steps, ["l_returnflag"], 4_096, 1e9, 1e12)
    return got.select("l_returnflag", F.round("mean_seconds", 9).alias("mean_seconds"), "median_seconds", "p90_seconds", F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query("agg_17_final_runs", "SELECT s_suppkey AS candidate_id, (s_acctbal + s_nationkey) / 2 AS monitor_nll, (s_acctbal + 2 * s_nationkey) / 2 AS final_nll FROM supplier")
def final_runs(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("candidate_id"), F.col("s_acctbal").cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    runs = s.select("candidate_id", F.lit("first").alias("run"), F.col("x").alias("monitor_nll"), F.col("x").alias("final_nll"))
    return curves.final_runs(runs.unionByName(s.select("candidate_id", F.lit("second").alias("run"), F.col("y").alias("monitor_nll"), (F.col("y") * 2).alias("final_nll"))), ["second", "first"])


@query("flt_9_eligible", f"WITH {_RECORDS} SELECT candidate_id, lane, score FROM lanes")
def eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Failed candidates and lanes that aren't finite don't count."""
    records = base._records(spark, sf)
    odd = records.limit(1).select(F.lit("odd").alias("candidate_id"), F.lit("confirmed").alias("status"), F.lit(float("nan")).alias("quality"), F.lit(float("inf")).alias("efficiency"), F.lit(None).cast("double").alias("balanced"))
    return ranks.lane_rows(records.unionByName(odd))


@query("srt_3_lane_order", f"WITH {_RECORDS} SELECT lane, candidate_id, score, CAST(place AS INTEGER) AS place FROM lanes WHERE place <= 12")
def lane_order(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.lane_top(base._records(spark, sf), dict.fromkeys(ranks.LANES, 12)).select("lane", "candidate_id", "score", "place")


@query(
    "srt_5_second_promotion",
    f"""WITH {_RECORDS}, w AS (SELECT candidate_id, min((CASE lane WHEN 'quality' THEN 0 WHEN 'balanced' THEN 1 ELSE 2 END) * 1000 + place) AS p FROM lanes WHERE place <= 1 GROUP BY candidate_id),
        u AS (SELECT * FROM w UNION ALL SELECT candidate_id, 3000 + place FROM lanes WHERE lane = 'balanced' AND candidate_id NOT IN (SELECT candidate_id FROM w))
        SELECT candidate_id, CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS place FROM u ORDER BY p LIMIT 3""",
)
def second_promotion(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.promote_rung(base._records(spark, sf), (8, 16, 32), 16)


@query("srt_9_roles", f"WITH {_RECORDS} SELECT (SELECT candidate_id FROM r ORDER BY quality, candidate_id LIMIT 1) AS best, (SELECT candidate_id FROM r ORDER BY efficiency, candidate_id LIMIT 1) AS cheapest")
def roles(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.roles(base._records(spark, sf), {"best": "quality", "cheapest": "efficiency"})


@query("srt_10_top_logits", "WITH k AS (SELECT o_custkey, o_orderkey, o_totalprice, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) SELECT o_custkey, count(*) AS n, sum(CASE WHEN r <= 3 THEN 1 ELSE 0 END)::BIGINT AS kept FROM k GROUP BY o_custkey")
def top_logits(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_totalprice").cast("double")).alias("x"))
    kept = F.filter(ranks.top_logits(F.col("x"), 3), lambda v: v > float("-inf"))
    return held.select("o_custkey", F.size("x").cast("long").alias("n"), F.size(kept).cast("long").alias("kept"))


@query("fn_27_time_budget", "SELECT o_orderkey, o_totalprice - 1000 AS elapsed, greatest(36000 * 3 - (o_totalprice - 1000), 0) AS left_over, o_totalprice - 1000 >= 36000 * 3 AS spent FROM orders")
def time_budget(spark: SparkSession, sf: str) -> DataFrame:
    got = table(spark, sf, "orders").select("o_orderkey", ranks.time_budget(F.lit(1_000), F.col("o_totalprice"), 30.0).alias("b"))
    return got.select("o_orderkey", F.col("b.elapsed").alias("elapsed"), F.col("b.left").alias("left_over"), F.col("b.over").alias("spent"))


# --- study records --------------------------------------------------------------------------------


def _study(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("long")
    status = F.element_at(F.array(*map(F.lit, ("failed", "completed", "running", "pending"))), (key % 4 + 1).cast("int"))
    return s.select(
        F.format_string("%06d", key).alias("candidate_id"), F.concat(F.lit("s"), key.cast("string")).alias("digest"), (key % 3).cast("int").alias("generation"), status.alias("status"),
        (key % 5 * 8).alias("rung"), F.when(key % 2 == 0, key % 40).alias("trained_tokens"), F.col("s_acctbal").cast("double").alias("quality"),
        F.when(key % 6 != 0, F.lit(1.0)).alias("balanced"), F.lit(2.0).alias("efficiency"),
    )


_STUDY = """st AS (SELECT printf('%06d', s_suppkey) AS candidate_id, s_suppkey AS k, 's' || s_suppkey AS digest, s_suppkey % 3 AS generation, ['failed', 'completed', 'running', 'pending'][s_suppkey % 4 + 1] AS status,
    s_suppkey % 5 * 8 AS rung, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 40 END AS trained_tokens FROM supplier)"""


@query("flt_10_parent_pool", f"WITH {_STUDY} SELECT candidate_id FROM st WHERE status <> 'failed' AND coalesce(trained_tokens, rung) >= 16 AND k % 6 <> 0")
def parent_pool(spark: SparkSession, sf: str) -> DataFrame:
    return search.parent_pool(_study(spark, sf), 16).select("candidate_id")


@query("flt_12_cohort", f"WITH {_STUDY} SELECT candidate_id FROM st WHERE generation = 1 AND status <> 'failed' AND rung >= 16")
def cohort(spark: SparkSession, sf: str) -> DataFrame:
    return search.cohort(_study(spark, sf), 1, 16).select("candidate_id")


@query("flt_14_first_incomplete", f"WITH {_STUDY} SELECT min(candidate_id) AS candidate_id FROM st WHERE status IN ('pending', 'running')")
def first_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(search.first_incomplete(_study(spark, sf)),)], "candidate_id string")


@query("agg_25_checkpoint_bytes", "SELECT CAST(sum(s_suppkey * 4) AS BIGINT) AS bytes FROM supplier")
def checkpoint_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(search.checkpoint_bytes(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("weight_bytes"))),)], "bytes long")


@query("fn_20_checkpoint_names", "SELECT 'c/model_' || c_custkey || '.pt' AS path FROM customer WHERE c_custkey NOT IN (8, 16) UNION ALL SELECT 'c/x' || c_custkey || '.tmp' FROM customer")
def checkpoint_names(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    names = F.explode(F.array(F.concat(F.lit("c/model_"), key, F.lit(".pt")), F.concat(F.lit("c/x"), key, F.lit(".tmp")), F.concat(F.lit("c/note_"), key)))
    return search.stale_checkpoints(table(spark, sf, "customer").select(names.alias("path"), F.lit(1).alias("length")), [8, 16]).select("path")


_PLANS = f"""{_STUDY}, pl AS (SELECT 's' || s_suppkey AS digest, s_suppkey AS place, NULL AS parent_digest FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT 'c' || c_custkey, 100000 + c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 's3' END FROM customer),
    fresh AS (SELECT *, row_number() OVER (ORDER BY place) + (SELECT max(k) FROM st) AS id FROM pl WHERE digest NOT IN (SELECT digest FROM st))"""


def _materialized(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "supplier").where("s_suppkey % 3 = 1").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("digest"), F.col("s_suppkey").cast("long").alias("place"), F.lit(None).cast("string").alias("parent_digest"))
    new = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("digest"), (F.lit(100_000) + F.col("c_custkey")).cast("long").alias("place"), F.when(F.col("c_custkey") % 2 == 0, "s3").alias("parent_digest"))
    plans = old.unionByName(new).withColumns({"mutation": F.lit("none"), "architecture": F.lit("{}")})
    return search.materialize(_study(spark, sf), plans, 1)


@query("joi_8_new_plans", f"WITH {_PLANS} SELECT digest FROM fresh")
def new_plans(spark: SparkSession, sf: str) -> DataFrame:
    return _materialized(spark, sf).select("digest")


@query("joi_9_parents", f"WITH {_PLANS} SELECT printf('%06d', id) AS candidate_id, CASE WHEN parent_digest IS NOT NULL THEN '000003' END AS parent FROM fresh")
def parents(spark: SparkSession, sf: str) -> DataFrame:
    return _materialized(spark, sf).select("candidate_id", "parent")


@query("agg_24_next_ids", f"WITH {_PLANS} SELECT printf('%06d', min(id)) AS first, printf('%06d', max(id)) AS last, count(*) AS n FROM fresh")
def next_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _materialized(spark, sf).agg(F.min("candidate_id").alias("first"), F.max("candidate_id").alias("last"), F.count(F.lit(1)).alias("n"))


@query("str_9_point_upserts", "SELECT o_custkey AS candidate_id, o_orderkey AS tokens, CASE WHEN o_orderkey % 5 = 0 THEN 2.0::DOUBLE ELSE o_totalprice END AS nll FROM orders UNION ALL SELECT c_custkey, -1, 2.0::DOUBLE FROM customer")
def point_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Of a batch's points for one place the last one wins."""
    orders = table(spark, sf, "orders")
    points = orders.select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").cast("long").alias("tokens"), F.col("o_totalprice").cast("double").alias("nll"))
    again = orders.where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").cast("long").alias("tokens")).unionByName(table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), F.lit(-1).cast("long").alias("tokens")))
    return ingest.upsert_points(points, again.select("candidate_id", "tokens", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).withColumn("nll", F.col("seq").cast("double")))


# --- configurations -------------------------------------------------------------------------------

_OPS = base._ops_sql()
_COUNTED = f"""x AS (SELECT id, sum({base._LINEAR_SQL}) AS linear, sum(CASE kind WHEN 'attention' THEN 12 * least(2048, coalesce(win, 2048)) * w ELSE 0 END) AS att, sum(CASE WHEN first AND before <> w THEN before * w ELSE 0 END) AS adapters,
    count(*) FILTER (first) AS logical_depth, count(DISTINCT g * 1000 + r) AS unique_parameter_blocks FROM o GROUP BY id)"""


def _metrics(spark: SparkSession) -> DataFrame:
    return genome.metrics(genome.genome_table(spark, base.demo_configs()), 2048)


@query("agg_22_flops", f"WITH {_OPS}, {_COUNTED} SELECT id AS candidate_id, CAST(6 * (v * e + adapters + CASE WHEN last <> e THEN last * e ELSE 0 END + linear) + att AS BIGINT) AS flops_per_token FROM x JOIN e USING (id)")
def flops(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark).select("candidate_id", "flops_per_token")


@query("agg_27_unique_blocks", f"WITH {_OPS}, {_COUNTED} SELECT id AS candidate_id, logical_depth, unique_parameter_blocks FROM x")
def unique_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark).select("candidate_id", "logical_depth", "unique_parameter_blocks")


@query("win_8_occurrences", f"WITH {_OPS} SELECT id AS candidate_id, CAST(max(place) AS INTEGER) AS last, count(*) AS n FROM o WHERE first GROUP BY id")
def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    got = genome.executed_blocks(genome.genome_table(spark, base.demo_configs()))
    return got.groupBy("candidate_id").agg(F.max("occurrence").cast("int").alias("last"), F.count(F.lit(1)).alias("n"))


@query("fn_22_close_sums", "SELECT name, abs(total - 1) <= 1e-9 AS ok FROM (SELECT n_regionkey AS name, sum(1.0::DOUBLE / 5 + CASE WHEN n_nationkey = 3 THEN 0.001 ELSE 0 END) AS total FROM nation GROUP BY 1)")
def close_sums(spark: SparkSession, sf: str) -> DataFrame:
    shares = table(spark, sf, "nation").select(F.col("n_regionkey").alias("name"), (F.lit(0.2) + F.when(F.col("n_nationkey") == 3, 0.001).otherwise(0.0)).alias("p"))
    return genome.probabilities_ok(shares, "name", "p")
