"""Queries over the supplied tables for the engine's operators, and the same in SQL.

own input (configurations, candidates, phases) stand in for it or are given as values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .config import Phase, Source
from .functions import text as tx
from .functions.tokens import ByteTokenizer
from .operators import curves, genome, pack, ranks, schedule
from .sources import documents as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A mixture over three sources for the schedule queries.
PHASES = (Phase(200_000, {"a": 50, "b": 30, "c": 20}), Phase(300_000, {"a": 10, "b": 30, "c": 60}), Phase(400_000, {"a": 34, "b": 33, "c": 33}))
STRIDE = 512
#: Targets of the acceptance queries for each of the sources src0 to src19.
TRAIN, VAL, FRACTION = 40_000, 15_000, 0.3
SOURCES = tuple(f"src{k}" for k in range(20))
SHARD = 10_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- scans, filters, identity ---------------------------------------------------------------------

_SPEC = Source("documents", "local", "", "text", language_column="lang", score_column="quality", min_score=0.5, language="en", metadata_columns={"origin": "source"})


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return table(spark, sf, "documents").join(labels, "doc_id", "left")


@query(
    "src_5_filtered_scan",
    """SELECT d.doc_id AS row, d.text AS content, CAST(l.quality AS DOUBLE) AS score, d.source AS origin FROM documents d JOIN labels l USING (doc_id)
       WHERE d.text <> '' AND length(d.text) BETWEEN 200 AND 20000 AND d.lang = 'en' AND l.quality >= 0.5""",
)
def filtered_scan(spark: SparkSession, sf: str) -> DataFrame:
    got = src.in_memory(_scored(spark, sf), _SPEC, "doc_id", 200, 20_000)
    return got.select("row", "content", "score", F.col("metadata")["origin"].alias("origin"))


@query(
    "flt_1_document_filters",
    """SELECT source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents
       WHERE text IS NOT NULL AND text <> '' AND length(text) BETWEEN 200 AND 100000 AND lang = 'en' GROUP BY source""",
)
def document_filters(spark: SparkSession, sf: str) -> DataFrame:
    spec = Source("documents", "local", "", "text", language_column="lang", language="en", metadata_columns={"source": "source"})
    got = src.in_memory(table(spark, sf, "documents"), spec, "doc_id", 200, 100_000)
    return got.groupBy(F.col("metadata")["source"].alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("content")).alias("chars"))


@query(
    "flt_4_score_filter",
    """SELECT d.doc_id AS row, doc_id % 4 = 0 AS is_nan, CASE doc_id % 4 WHEN 1 THEN CAST(l.quality AS DOUBLE) WHEN 2 THEN 0.75 END AS score FROM documents d LEFT JOIN labels l USING (doc_id)
       WHERE d.text <> '' AND (doc_id % 4 IN (0, 2) OR doc_id % 4 = 1 AND l.quality >= 0.5)""",
)
def score_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Scores as text: a number, NaN (which passes), or none (which doesn't)."""
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, "nan").when(kind == 1, F.col("quality").cast("string")).when(kind == 2, " 0.7_5 ")
    spec = Source("documents", "local", "", "text", score_column="score_text", min_score=0.5)
    got = src.in_memory(_scored(spark, sf).withColumn("score_text", raw), spec, "doc_id", 0, 10**9)
    return got.select("row", F.isnan("score").alias("is_nan"), F.when(~F.isnan("score"), F.col("score")).alias("score"))


@query("fn_6_content_hash", "SELECT doc_id, sha256(text) AS content_hash, length(text) AS chars, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.content_digest(F.col("text")).alias("content_hash"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query("ded_1_normalize", f"SELECT doc_id, {_NORM} AS normalised FROM documents")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.normalize_native(F.col("text")).alias("normalised"))


@query("ded_2_fingerprints")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """NFKC and BLAKE2 have no SQL; tests compare with hashlib."""
    docs = table(spark, sf, "documents").withColumn("f", tx.fingerprint(F.col("text"), 42, 0.02))
    return docs.select("doc_id", F.lower(F.hex("f.dedup_hash")).alias("dedup_hash"), F.col("f.split").alias("split"))


@query(
    "ded_3_first_occurrence",
    f"SELECT source, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, source, {_NORM} AS body FROM documents) GROUP BY source, body",
)
def first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", F.col("doc_id").alias("row"), F.lit(0).alias("file_ord"), F.md5(F.concat_ws("|", "source", tx.normalize_native(F.col("text")))).alias("dedup_hash"))
    copies = docs.groupBy("dedup_hash").agg(F.count(F.lit(1)).alias("copies"))
    return pack.first_occurrences(docs).join(copies, "dedup_hash").select("source", F.col("row").alias("doc_id"), "copies")


_SPLIT_SQL = f"CASE WHEN CAST('0x' || substr(sha256({_NORM}), 1, 15) AS BIGINT) < {int(FRACTION * 16**15)} THEN 'val' ELSE 'train' END"


@query("spl_1_hash_split", f"SELECT doc_id, {_SPLIT_SQL} AS split FROM documents")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.fingerprint_native(F.col("text"), FRACTION)["split"].alias("split"))


# --- acceptance, spans, shards --------------------------------------------------------------------


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where((F.col("text") != "") & F.length("text").between(1, 100_000))
    marked = docs.withColumn("f", tx.fingerprint_native(F.col("text"), FRACTION))
    return marked.select(
        "source", F.col("doc_id").alias("row"), F.lit(0).alias("file_ord"), F.col("f.dedup_hash").alias("dedup_hash"), F.col("f.split").alias("split"),
        ByteTokenizer.length_column(F.col("text")).alias("n_tokens"),
    )


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    docs = _candidates(spark, sf).withColumnRenamed("source", "source_id")
    order = spark.createDataFrame([(s, k) for k, s in enumerate(SOURCES)], "source_id string, source_ord int")
    targets = spark.createDataFrame([(s, t, n) for s in SOURCES for t, n in (("train", TRAIN), ("val", VAL))], "source_id string, split string, target long")
    return pack.accept_all(docs.join(F.broadcast(order), "source_id"), targets)


def _accept_sql() -> str:
    steps = [f"""WITH c AS MATERIALIZED (SELECT source, doc_id AS row, substr(sha256({_NORM}), 1, 32) AS h, {_SPLIT_SQL} AS split, CAST(strlen(text) AS BIGINT) + 2 AS n
                 FROM documents WHERE text <> '' AND length(text) BETWEEN 1 AND 100000)"""]
    for k, s in enumerate(SOURCES):
        before = f"AND h NOT IN (SELECT h FROM t{k - 1})" if k else ""
        steps.append(f"""f{k} AS (SELECT h, min(row) AS row FROM c WHERE source = '{s}' {before} GROUP BY h),
            a{k} AS MATERIALIZED (SELECT * FROM (SELECT c.source AS source_id, c.split, c.row, c.h, c.n AS n_tokens,
                CAST(coalesce(sum(c.n) OVER (PARTITION BY c.split ORDER BY c.row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_token
                FROM c JOIN f{k} USING (h, row) WHERE c.source = '{s}') WHERE start_token < CASE split WHEN 'val' THEN {VAL} ELSE {TRAIN} END),
            t{k} AS MATERIALIZED (SELECT * FROM a{k}{f" UNION ALL SELECT * FROM t{k - 1}" if k else ""})""")
    return ",\n".join(steps)


_ACCEPT_SQL, _LAST = _accept_sql(), f"t{len(SOURCES) - 1}"


@query("ded_4_accept_across_sources", f"{_ACCEPT_SQL} SELECT source_id, split, row, h AS dedup_hash, n_tokens, start_token, start_token + n_tokens AS end_token FROM {_LAST}")
def accept_across_sources(spark: SparkSession, sf: str) -> DataFrame:
    got = _accepted(spark, sf)
    return got.select("source_id", "split", "row", F.lower(F.hex("dedup_hash")).alias("dedup_hash"), "n_tokens", "start_token", "end_token")


@query(
    "agg_2_split_totals",
    f"""{_ACCEPT_SQL} SELECT source_id, split, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS documents,
        CAST(sum(n_tokens) AS BIGINT) - CASE split WHEN 'val' THEN {VAL} ELSE {TRAIN} END AS overshoot FROM {_LAST} GROUP BY source_id, split""",
)
def split_totals(spark: SparkSession, sf: str) -> DataFrame:
    totals = pack.split_totals(_accepted(spark, sf))
    return totals.withColumn("overshoot", F.col("tokens") - F.when(F.col("split") == "val", VAL).otherwise(TRAIN))


@query(
    "agg_4_totals_rollup",
    """SELECT source, lang, CAST(sum(strlen(text) + 2) AS BIGINT) AS tokens, count(*) AS documents FROM documents GROUP BY ROLLUP (source, lang)""",
)
def totals_rollup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("n", ByteTokenizer.length_column(F.col("text")))
    return docs.rollup("source", "lang").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("documents"))


@query(
    "win_1_running_offsets",
    """SELECT source, doc_id, CAST(coalesce(sum(strlen(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM documents""",
)
def running_offsets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id", F.lit(0).alias("file_ord"), ByteTokenizer.length_column(F.col("text")).alias("n"))
    return pack.running_offsets(docs, "n", ("source",), row="doc_id").select("source", "doc_id", "offset")


_SEGMENTS_SQL = f"""{_ACCEPT_SQL}, e AS (SELECT source_id, split, row, start_token, start_token + n_tokens AS end_token,
        unnest(range(start_token // {SHARD}, (start_token + n_tokens - 1) // {SHARD} + 1)) AS shard FROM {_LAST}),
    g AS (SELECT source_id, split, row, shard, greatest(start_token, shard * {SHARD}) AS from_token, least(end_token, (shard + 1) * {SHARD}) AS to_token FROM e)"""


@query("snk_1_shard_segments", f"{_SEGMENTS_SQL} SELECT source_id, split, row, shard, from_token, to_token FROM g")
def shard_segments(spark: SparkSession, sf: str) -> DataFrame:
    got = pack.shard_segments(_accepted(spark, sf), SHARD, by_file=False)
    return got.select("source_id", "split", "row", F.col("shard").cast("long").alias("shard"), "from_token", "to_token")


@query(
    "win_2_shard_ends",
    f"""{_SEGMENTS_SQL}, s AS (SELECT source_id, split, shard, CAST(sum(to_token - from_token) AS BIGINT) AS tokens FROM g GROUP BY ALL)
        SELECT source_id, split, shard, tokens, CAST(sum(tokens) OVER (PARTITION BY source_id, split ORDER BY shard) AS BIGINT) AS "end" FROM s""",
)
def shard_ends(spark: SparkSession, sf: str) -> DataFrame:
    got = pack.shard_table(pack.shard_segments(_accepted(spark, sf), SHARD, by_file=False))
    return got.withColumn("shard", F.col("shard").cast("long"))


@query("src_10_token_range")
def token_range(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens 1,000 to 1,512 of every stream; tests compare with plain lists."""
    docs = _candidates(spark, sf).drop("source").join(table(spark, sf, "documents").select(F.col("doc_id").alias("row"), "source", "text"), "row")
    placed = pack.running_offsets(docs, "n_tokens", ("source", "split")).withColumnRenamed("source", "source_id")
    bytes_of = F.transform(F.expr("sequence(1, octet_length(text))"), lambda i: F.expr("0") + F.conv(F.substring(F.hex(F.encode("text", "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("int") + 3)
    near = placed.where((F.col("offset") < 1_512) & (F.col("offset") + F.col("n_tokens") > 1_000))
    runs = near.select("source_id", "split", F.col("offset").alias("start_token"), F.concat(F.array(F.lit(1)), bytes_of, F.array(F.lit(2))).alias("tokens"))
    return pack.read_tokens(runs, 1_000, 512)


@query("chk_6_unique_digests", f"{_ACCEPT_SQL} SELECT count(*) AS rows, count(DISTINCT h) AS hashes FROM {_LAST}")
def unique_digests(spark: SparkSession, sf: str) -> DataFrame:
    return _accepted(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("dedup_hash").alias("hashes"))


# --- mixture, schedule ----------------------------------------------------------------------------

_PHASES_SQL = "p(phase, start_tokens, end_tokens, source_id, weight) AS (VALUES " + ", ".join(
    f"({i}, {([0] + [p.end for p in PHASES])[i]}, {p.end}, '{s}', {w})" for i, p in enumerate(PHASES) for s, w in p.weights.items()
) + ")"
_CYCLE_SQL = "y(phase, slot, source_id) AS (VALUES " + ", ".join(f"({i}, {k}, '{s}')" for i, p in enumerate(PHASES) for k, s in enumerate(schedule.smooth_cycle(p.weights))) + ")"
_PICKS_SQL = f"""WITH {_CYCLE_SQL}, {_PHASES_SQL}, b AS (SELECT range AS batch, range * {STRIDE} AS o FROM range(1000)),
    q AS (SELECT batch, o, CASE WHEN o >= 300000 THEN 2 WHEN o >= 200000 THEN 1 ELSE 0 END AS phase FROM b),
    z AS (SELECT batch, o, q.phase, greatest(batch - CASE q.phase WHEN 0 THEN 0 WHEN 1 THEN (200000 + {STRIDE - 1}) // {STRIDE} ELSE (300000 + {STRIDE - 1}) // {STRIDE} END, 0) % 100 AS slot FROM q),
    s AS (SELECT batch, o AS "offset", z.phase, source_id FROM z JOIN y ON y.phase = z.phase AND y.slot = z.slot)"""


@query("agg_1_quotas", f"WITH {_PHASES_SQL} SELECT source_id, CAST(sum((end_tokens - start_tokens) * weight // 100) AS BIGINT) AS quota FROM p GROUP BY source_id")
def quota_query(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.quota_table(schedule.phase_table(spark, PHASES))


@query("sch_2_schedule", f"{_PICKS_SQL} SELECT * FROM s")
def schedule_query(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.schedule(spark, PHASES, STRIDE, 1_000)


@query("sch_2_validation_schedule", f"SELECT range AS batch, range * {STRIDE} AS \"offset\", 'validation' AS phase, ['a', 'b', 'c'][range % 3 + 1] AS source_id FROM range(100)")
def validation_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.validation_schedule(spark, ["a", "b", "c"], STRIDE, 100)


@query(
    "sch_4_selection_counts",
    f"""{_PICKS_SQL}, o AS (SELECT range * {STRIDE} * 50 AS "offset" FROM range(20)), k AS (SELECT DISTINCT source_id FROM p)
        SELECT o."offset", k.source_id, count(s.batch) AS picks FROM o CROSS JOIN k LEFT JOIN s ON s.source_id = k.source_id AND s."offset" < o."offset" GROUP BY 1, 2""",
)
def selection_counts(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.counts_table(spark, PHASES, STRIDE, spark.range(20).select((F.col("id") * STRIDE * 50).alias("offset")))


@query(
    "sch_5_source_offsets",
    f"""{_PICKS_SQL} SELECT batch, "offset", source_id, (row_number() OVER (PARTITION BY source_id ORDER BY batch) - 1) * {STRIDE} AS source_offset FROM s""",
)
def source_offsets(spark: SparkSession, sf: str) -> DataFrame:
    picks = schedule.schedule(spark, PHASES, STRIDE, 1_000)
    counts = schedule.counts_table(spark, PHASES, STRIDE, picks.select("offset"))
    return picks.join(counts, ["offset", "source_id"]).select("batch", "offset", "source_id", (F.col("picks") * STRIDE).cast("long").alias("source_offset"))


@query("fn_15_lr_scale", "SELECT range AS step, CASE WHEN range < 20 THEN (range + 1) / 20.0::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (range - 20) / 180.0::DOUBLE))) END AS scale FROM range(220)")
def lr_scale(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(220).select(F.col("id").alias("step"), curves.lr_scale(F.col("id"), 200, 20, 0.1).alias("scale"))


# --- study analytics ------------------------------------------------------------------------------

_MID = "(rank() OVER (PARTITION BY {by} ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY {by}) - 1)"


@query(
    "win_4_mid_ranks",
    "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) = 1 THEN 0 ELSE " + _MID.format(by="p_brand", v="p_size") + " END AS mid_rank FROM part",
)
def mid_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.mid_ranks(table(spark, sf, "part"), "p_size", "mid_rank", ["p_brand"]).select("p_partkey", "mid_rank")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as candidates: balance, nation and key give the lanes; each seventh one failed."""
    s = table(spark, sf, "supplier")
    return s.select(
        F.format_string("%06d", "s_suppkey").alias("candidate_id"),
        F.when(F.col("s_suppkey") % 7 == 3, "failed").otherwise("confirmed").alias("status"),
        F.col("s_acctbal").alias("quality"),
        (F.col("s_nationkey") * 1.0).cast("double").alias("efficiency"),
        ((F.col("s_acctbal") + F.col("s_nationkey") * 100) / 2).alias("balanced"),
    )


_RECORDS_SQL = """r AS (SELECT printf('%06d', s_suppkey) AS candidate_id, s_suppkey % 7 = 3 AS failed, s_acctbal AS quality, CAST(s_nationkey AS DOUBLE) AS efficiency, (s_acctbal + s_nationkey * 100) / 2 AS balanced FROM supplier),
    lanes AS (SELECT candidate_id, lane, score, row_number() OVER (PARTITION BY lane ORDER BY score, candidate_id) AS place FROM
        (SELECT candidate_id, unnest(['quality', 'balanced', 'efficiency']) AS lane, unnest([quality, balanced, efficiency]) AS score FROM r WHERE NOT failed))"""


@query("win_6_lane_leaders", f"WITH {_RECORDS_SQL} SELECT lane, candidate_id, score FROM lanes WHERE place = 1")
def lane_leaders(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.lane_leaders(_records(spark, sf)).select("lane", "candidate_id", "score")


@query("win_7_lane_top", f"WITH {_RECORDS_SQL} SELECT lane, candidate_id, score, CAST(place AS INTEGER) AS place FROM lanes WHERE place <= 2")
def lane_top(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.lane_top(_records(spark, sf), ranks.RETAINED).select("lane", "candidate_id", "score", "place")


@query(
    "srt_4_promotions",
    f"""WITH {_RECORDS_SQL}, w AS (SELECT candidate_id, min((CASE lane WHEN 'quality' THEN 0 WHEN 'balanced' THEN 1 ELSE 2 END) * 1000 + place) AS p FROM lanes
        WHERE place <= CASE lane WHEN 'quality' THEN 2 ELSE 1 END GROUP BY candidate_id),
        u AS (SELECT * FROM w UNION ALL SELECT candidate_id, 3000 + place FROM lanes WHERE lane = 'balanced' AND candidate_id NOT IN (SELECT candidate_id FROM w))
        SELECT candidate_id, CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS place FROM u ORDER BY p LIMIT 4""",
)
def promotions(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.promote_rung(_records(spark, sf), (8, 16, 32), 8)


@query("srt_6_top_half", f"WITH {_RECORDS_SQL} SELECT lane, candidate_id, score, CAST(place AS INTEGER) AS place FROM lanes WHERE lane = 'quality' AND place <= greatest(1, (SELECT (count(*) + 1) // 2 FROM lanes WHERE lane = 'quality'))")
def top_half(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.top_half(_records(spark, sf), "quality").select("lane", "candidate_id", "score", "place")


@query("srt_7_retained", f"WITH {_RECORDS_SQL} SELECT DISTINCT candidate_id FROM lanes WHERE place <= 2")
def retained(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.retained(_records(spark, sf))


@query("srt_8_finalists", f"WITH {_RECORDS_SQL} SELECT max(candidate_id) FILTER (lane = 'quality') AS quality, max(candidate_id) FILTER (lane = 'balanced') AS balanced, max(candidate_id) FILTER (lane = 'efficiency') AS efficiency FROM lanes WHERE place = 1")
def finalists(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.finalists(_records(spark, sf))


#: Tokens between two points of a curve, and the projection's horizon.
_STEP, _HORIZON = 1_000, 100_000


def _curves(spark: SparkSession, sf: str) -> DataFrame:
    """A curve for each part: all its order lines in turn, a fixed number of tokens apart, with discount-shaped losses."""
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount")
    points = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("candidate_id"), (F.row_number().over(order) * _STEP).cast("long").alias("tokens"), (F.lit(5.0) - F.col("l_discount")).alias("nll"))
    curve = F.collect_list(F.struct("tokens", "nll")).alias("nll_curve")  # of one part
    return points.groupBy("candidate_id").agg(curve).withColumn("status", F.when(F.col("candidate_id") % 11 == 0, "failed").otherwise("completed"))


_CURVES_SQL = f"""pts AS (SELECT l_partkey AS candidate_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_discount) AS k, 5.0::DOUBLE - l_discount AS nll FROM lineitem),
    sized AS (SELECT *, count(*) OVER (PARTITION BY candidate_id) AS n FROM pts),
    last3 AS (SELECT candidate_id, log2(k * {_STEP}.0::DOUBLE) AS x, nll AS y, k, n FROM sized WHERE n >= 3 AND k > n - 3 AND candidate_id % 11 <> 0),
    reg AS (SELECT candidate_id, regr_slope(y, x) AS measured_slope, CASE WHEN max(y) = min(y) THEN 0 ELSE greatest(0, least(1, regr_r2(y, x))) END AS r_squared,
        max(k) * {_STEP} AS current_tokens, max_by(y, k) AS current_nll FROM last3 GROUP BY candidate_id),
    fc AS (SELECT *, r_squared * measured_slope + (1 - r_squared) * (SELECT median(measured_slope) FROM reg) AS effective_slope FROM reg),
    pj AS (SELECT *, current_nll + effective_slope * log2({_HORIZON}.0::DOUBLE / current_tokens) AS projected_nll FROM fc)"""


@query("agg_11_regression", f"WITH {_CURVES_SQL} SELECT candidate_id, round(measured_slope, 7) + 0.0::DOUBLE AS measured_slope, round(r_squared, 6) AS r_squared, current_tokens, current_nll FROM reg")
def regression(spark: SparkSession, sf: str) -> DataFrame:
    got = curves.regressions(_curves(spark, sf).where("status <> 'failed'"))
    return got.select("candidate_id", (F.round("measured_slope", 7) + F.lit(0.0)).alias("measured_slope"), F.round("r_squared", 6).alias("r_squared"), "current_tokens", "current_nll")


@query("fn_16_projection", f"WITH {_CURVES_SQL} SELECT candidate_id, round(effective_slope, 6) + 0.0::DOUBLE AS effective_slope, round(projected_nll, 6) AS projected_nll FROM pj")
def projection(spark: SparkSession, sf: str) -> DataFrame:
    got = curves.forecasts(curves.regressions(_curves(spark, sf).where("status <> 'failed'")), _HORIZON)
    return got.select("candidate_id", (F.round("effective_slope", 6) + F.lit(0.0)).alias("effective_slope"), F.round("projected_nll", 6).alias("projected_nll"))


@query("gen_7_quality_scores")
def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of projections turn on the last bits of ties; tests compare with plain Python."""
    return curves.quality_scores(_curves(spark, sf), _HORIZON).select("candidate_id", F.round("quality", 6).alias("quality"))


_EFF = {"latency": ["p_size", "price"], "memory": ["key"]}
_EFF_SQL = "WITH m AS (SELECT p_partkey AS candidate_id, " + ", ".join("(rank() OVER (ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1) AS {n}".format(v=v, n=n) for n, v in (("a", "p_size"), ("b", "p_retailprice"), ("c", "p_partkey"))) + " FROM part) SELECT candidate_id, round((a + b) / 2, 9) AS latency, round(c, 9) AS memory, round(((a + b) / 2 + c) / 2, 9) AS efficiency FROM m"


@query("gen_9_efficiency", _EFF_SQL)
def efficiency(spark: SparkSession, sf: str) -> DataFrame:
    metrics = table(spark, sf, "part").select(F.col("p_partkey").alias("candidate_id"), "p_size", F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("key"))
    got = curves.efficiency_scores(metrics, _EFF)
    return got.select("candidate_id", *[F.round(c, 9).alias(c) for c in ("latency", "memory", "efficiency")])


@query(
    "agg_14_nearest_rank",
    """SELECT event_type, count(*) AS n, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.5::DOUBLE, 0) AS INTEGER) + 1] AS p50, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.95::DOUBLE, 0) AS INTEGER) + 1] AS p95
       FROM events WHERE value IS NOT NULL GROUP BY event_type""",
)
def nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    got = ranks.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return got.withColumn("n", F.col("n").cast("long"))


@query("agg_10_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = ranks.status_counts(table(spark, sf, "orders"), "o_orderstatus")
    return counts.select(F.explode("counts").alias("status", "n"))


@query(
    "srt_2_latest_upsert",
    """WITH m AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY o_custkey)
       SELECT o_custkey, o_orderkey AS tokens, CASE WHEN o_orderkey = last THEN 1.0::DOUBLE ELSE o_totalprice END AS nll FROM orders JOIN m USING (o_custkey)""",
)
def latest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as a curve, whose last point is replaced."""
    curve = F.collect_list(F.struct(F.col("o_orderkey").cast("long").alias("tokens"), F.col("o_totalprice").cast("double").alias("nll")))
    held = table(spark, sf, "orders").groupBy("o_custkey").agg(curve.alias("c"), F.max("o_orderkey").cast("long").alias("last"))
    put = curves.upsert_point(F.col("c"), F.struct(F.col("last").alias("tokens"), F.lit(1.0).alias("nll")))
    return held.select("o_custkey", F.explode(put).alias("p")).select("o_custkey", "p.*")


@query("agg_18_validation_loss", "SELECT l_returnflag, avg(a) AS loss, exp(least(avg(a), 20)) AS perplexity FROM (SELECT l_returnflag, l_linenumber, avg(l_discount) AS a FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def validation_loss(spark: SparkSession, sf: str) -> DataFrame:
    losses = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("rank"), F.col("l_discount").alias("loss"))
    return curves.validation_loss(losses, ["l_returnflag"])


@query("fn_18_failures", """SELECT event_id, CASE WHEN lower(props) LIKE '%out of memory%' THEN 'oom' WHEN lower(props) LIKE '%non-finite%' OR lower(props) LIKE '%not finite%' THEN 'non_finite' ELSE 'runtime' END AS kind, right(trim(props), 8000) AS message FROM events""")
def failures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", curves.failure(F.col("props")).alias("f")).select("event_id", F.col("f.type").alias("kind"), F.col("f.message").alias("message"))


@query("fn_19_zero_padded_ids", "SELECT c_custkey, printf('%06d', c_custkey) AS candidate_id, CAST(regexp_extract('step_' || c_custkey || '.pt', '^step_(\\d+)\\.pt$', 1) AS BIGINT) AS step FROM customer")
def zero_padded_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    name = F.concat(F.lit("step_"), F.col("c_custkey").cast("string"), F.lit(".pt"))
    return c.select("c_custkey", F.format_string("%06d", "c_custkey").alias("candidate_id"), F.regexp_extract(name, r"^step_(\d+)\.pt$", 1).cast("long").alias("step"))


# --- configurations -------------------------------------------------------------------------------


def demo_configs(n: int = 24) -> dict[str, dict]:
    """A family of configurations by rule: widths, windows, kernels and repeats vary with the number."""
    out = {}
    for k in range(n):
        width = (256, 384, 512)[k % 3]
        attention = {"kind": "attention", "head_dim": (32, 64)[k % 2], "num_key_value_heads": (1, 2, 4)[k // 2 % 3] if width != 384 else 2}
        if k % 4 == 1:
            attention |= {"scope": "sliding", "window_size": 256 * (1 + k % 5)}
        conv = {"kind": "gated_causal_conv", "inner_size": width + 128 * (k % 3), "kernel_size": 3 + k % 4}
        swiglu = {"kind": "swiglu", "intermediate_size": width * (2 + k % 3)}
        groups = [{"block": {"hidden_size": width, "stages": [{"branches": [attention]}, {"branches": [swiglu]}]}, "repeat": 1 + k % 4, "weight_sharing": "all" if k % 4 and k % 2 else "none"}]
        groups.append({"block": {"hidden_size": (256, 512)[k % 2], "stages": [{"branches": [conv]}, {"branches": [{"kind": "swiglu", "intermediate_size": 512}]}]}, "repeat": 1 + k % 2})
        out[f"{k:06d}"] = {"blocks": groups, "embedding_size": (128, 256)[k // 3 % 2], "vocab_size": 8_000}
    return out


def _ops_sql() -> str:
    rows, spaces = [], []
    for name, c in demo_configs().items():
        before, place = c["embedding_size"], 0
        for g, group in enumerate(c["blocks"]):
            for r in range(group.get("repeat", 1)):
                w = group["block"]["hidden_size"]
                new = r == 0 or group.get("weight_sharing", "none") == "none"
                for s, stage in enumerate(group["block"]["stages"]):
                    for o in stage["branches"]:
                        v = [o.get(x) for x in ("head_dim", "num_key_value_heads", "window_size", "inner_size", "kernel_size", "intermediate_size")]
                        rows.append(f"('{name}', {place}, {s == 0}, {g}, {r if group.get('weight_sharing', 'none') == 'none' else 0}, {new}, {before}, {w}, '{o['kind']}', " + ", ".join("NULL" if x is None else str(x) for x in v) + ")")
                before, place = w, place + 1
        spaces.append(f"('{name}', {c['embedding_size']}, {c['vocab_size']}, {before})")
    return "o(id, place, first, g, r, fresh, before, w, kind, hd, kv, win, inner_, kernel, mid) AS (VALUES " + ", ".join(rows) + "), e(id, e, v, last) AS (VALUES " + ", ".join(spaces) + ")"


_LINEAR_SQL = "CASE kind WHEN 'attention' THEN 2 * w * w + 2 * w * kv * hd WHEN 'swiglu' THEN 3 * w * mid ELSE 4 * w * inner_ + inner_ * kernel END"
_STATE_SQL = "CAST(sum(CASE kind WHEN 'attention' THEN 4 * kv * hd * least({n}, coalesce(win, {n})) WHEN 'swiglu' THEN 0 ELSE 2 * inner_ * (kernel - 1) END) AS BIGINT) AS state_bytes_{n}"


@query(
    "agg_20_parameters",
    f"""WITH {_ops_sql()}, x AS (SELECT id, sum(CASE WHEN fresh THEN {_LINEAR_SQL} + w + CASE kind WHEN 'attention' THEN 2 * hd ELSE 0 END ELSE 0 END) AS ops,
        sum({_LINEAR_SQL}) AS linear, sum(CASE kind WHEN 'attention' THEN 12 * least(2048, coalesce(win, 2048)) * w ELSE 0 END) AS att, sum(CASE WHEN first AND before <> w THEN before * w ELSE 0 END) AS adapters,
        count(*) FILTER (first) AS logical_depth, count(DISTINCT g * 1000 + r) AS unique_parameter_blocks FROM o GROUP BY id),
        f AS (SELECT id, ops, linear, att, logical_depth, unique_parameter_blocks, last, v * e + adapters + CASE WHEN last <> e THEN last * e ELSE 0 END AS fixed FROM x JOIN e USING (id))
        SELECT id AS candidate_id, CAST(fixed + ops + last AS BIGINT) AS parameters, CAST(6 * (fixed + linear) + att AS BIGINT) AS flops_per_token, logical_depth, unique_parameter_blocks FROM f""",
)
def parameters(spark: SparkSession, sf: str) -> DataFrame:
    got = genome.metrics(genome.genome_table(spark, demo_configs()), 2048)
    return got.select("candidate_id", "parameters", "flops_per_token", "logical_depth", "unique_parameter_blocks")


@query("agg_21_state_bytes", f"WITH {_ops_sql()} SELECT id AS candidate_id, {_STATE_SQL.format(n=512)}, {_STATE_SQL.format(n=2048)}, {_STATE_SQL.format(n=4096)} FROM o GROUP BY id")
def state_bytes(spark: SparkSession, sf: str) -> DataFrame:
    got = genome.metrics(genome.genome_table(spark, demo_configs()), 2048)
    return got.select("candidate_id", "state_bytes_512", "state_bytes_2048", "state_bytes_4096")


@query("agg_19_executions", f"WITH {_ops_sql()} SELECT id AS candidate_id, kind, count(*) AS n FROM o GROUP BY id, kind")
def executions(spark: SparkSession, sf: str) -> DataFrame:
    return genome.executions(genome.genome_table(spark, demo_configs())).groupBy("candidate_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("win_9_execution_plan", f"WITH {_ops_sql()} SELECT id AS candidate_id, place AS occurrence, 'group_' || g || '_repeat_' || r AS weight_key, w AS width, before AS width_before FROM o WHERE first")
def execution_plan(spark: SparkSession, sf: str) -> DataFrame:
    got = genome.executed_blocks(genome.genome_table(spark, demo_configs()))
    return got.select("candidate_id", "occurrence", "weight_key", F.col("width").cast("int").alias("width"), F.col("width_before").cast("int").alias("width_before"))


@query("chk_13_probabilities", "SELECT o_orderpriority AS name, abs(sum(p) - 1) <= 1e-9 AS ok FROM (SELECT o_orderpriority, o_orderstatus, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS p FROM orders GROUP BY 1, 2) GROUP BY 1")
def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("name")))
    return genome.probabilities_ok(shares, "name", "p")
