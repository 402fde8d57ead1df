"""Queries of the operators in this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, exact_dedup, hmm, ngram_join, packing, pii, quality, reply_trees, site_tree, token_counts
from .tokens import path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_packing(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), path("word_bpe_49k.json", tokenizers), end_id=2, width=4096)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_table(spark, sf_dir, "documents"))


def op4_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(_table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(_table(spark, sf_dir, "documents")))


def op6_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    return token_counts.answers(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json", tokenizers), limit=512)


#: What the contract adds to the table: control strings inside both texts.
TEASER = r"\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TEASER), (-7, 1, "assistant", TEASER)], "conv_id long, turn long, role string, text string")
    done = reply_trees.format_paths(reply_trees.threads(rows.unionByName(extra)))
    return reply_trees.read_back(done).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr(r"array_join(transform(turns, x -> concat(x.role, '\n', x.text, '\n')), '')"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit, n_words = F.size("hit").cast("long"), F.col("n_words").cast("long")
    return seen.select(
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(n_hit, n_words).alias("contaminated"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, out_col="score")
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_site_tree": op4_site_tree,
    "op5_pii": op5_pii,
    "op6_token_counts": op6_token_counts,
    "op7_chat": op7_chat,
    "op8_hmm": op8_hmm,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {
    "op7_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(24 + length(replace(replace(role, '\', '\\'), '<|', '\l|')) + length(replace(replace(text, '\', '\\'), '<|', '\l|'))) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id
    """,
    "op1_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
    """,
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
        c AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
        SELECT n.doc_id, c.keep_id, c.group_size, n.doc_id = c.keep_id AS kept, sha256(n.body) AS text_sha256
        FROM n JOIN c USING (body)
    """,
    "op9_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        bs AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS body FROM bs),
        ks AS (SELECT DISTINCT k FROM bw),
        ds AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k),
        dw AS (SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS body FROM ds),
        hit AS (SELECT dw.doc_id, dw.s, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.body = bw.body),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
               sha256(coalesce(it.ids, '')) AS items_sha256,
               coalesce(pos.n_hit, 0) > 0 AND 20 * coalesce(pos.n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
}
