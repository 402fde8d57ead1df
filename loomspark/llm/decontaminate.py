"""Benchmark decontamination: broadcast set of test n-grams, scan of token windows.

A window is ``n`` consecutive words of an item, or the whole item when it has
fewer.  A document window of L words always covers a word position divisible by
``L - g + 1`` at which a whole ``g``-word gram of it starts.  The scan therefore
looks up one gram in about ten positions instead of every window: documents are
read once, tokenised once, and almost all of them end there.  Around a gram that
the benchmark knows, the candidate windows are spelled out and verified as
strings against the benchmark's windows.

The gram set travels with the plan while it has at most ``max_grams`` members;
above that the same grams are looked up by a join that Spark plans by size.

Cases: null and empty texts have no words and are never contaminated; repeated
rows are judged separately; items with equal windows all count; a null
``item_id`` is not reported but its words still count as hit; an empty benchmark
hits nothing, and an empty table gives an empty result; very long texts are scanned
whole; ties don't occur; columns besides id and text are not read by ``scan`` and are
kept by ``remove_documents``, whatever their names.  ``remove_documents`` drops rows, by id (null is one, too) and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .columns import lower_ascii, text_hash, without
from .scratch import Scratch

#: All that is not a digit, an ASCII letter or a character beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Normalised words of a text; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (len, body, item_id, words) of the benchmark's windows."""
    items = benchmark.select(F.col(id_col).alias("item_id"), word_list(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    starts = items.select("item_id", "w", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("s"))
    words = F.slice("w", F.col("s"), F.col("len"))
    return starts.select("len", "item_id", words.alias("words")).withColumn("body", F.array_join("words", " ")).distinct()


def _scan_sql(n_words: str, length: int, gram: int, known: str) -> str:
    """SQL for the candidate windows of one length: array of (at, len, body), 0-based, over the word array ``w``."""
    reach = length - gram
    spots = f"if({n_words} >= {length}, sequence(0, {n_words} - {gram}, {reach + 1}), cast(array() as array<int>))"
    hits = f"filter({spots}, p -> {known})"
    around = f"flatten(transform({hits}, p -> sequence(greatest(p - {reach}, 0), least(p, {n_words} - {length}))))"
    return (
        f"transform(array_distinct({around}), "
        f"a -> named_struct('at', a, 'len', {length}, 'body', array_join(slice(w, a + 1, {length}), ' ')))"
    )


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    gram: int = 4,
    max_grams: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, item_ids, hit (sorted word positions from 0)."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    windows = scratch.save(benchmark_windows(benchmark, n))
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # n values at most
    grams = scratch.save(
        windows.select("len", F.explode(F.expr(f"transform(sequence(1, len - least(len, {gram}) + 1), i -> xxhash64(slice(words, i, least(len, {gram}))))")).alias("g")).distinct()
    )
    # Set once per row of the scan; the same on a retry, as it follows the order in the files.
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), word_list(F.col(text_col)).alias("w"))
    # The join reads the rows twice and must find them under the same numbers: they are written first.
    found = _cands_by_set(base, grams, lengths, gram) if grams.count() <= max_grams else _cands_by_join(scratch.save(base), grams, lengths, gram)
    spread = found.select("rid", "doc_id", "n_words", F.explode_outer("cands").alias("c")).select("rid", "doc_id", "n_words", "c.*")
    texts = windows.select("body", "len", "item_id")
    hits = spread.join(texts.withColumn("known", F.lit(True)), ["len", "body"], "left")
    spans = F.flatten(F.collect_set(F.when(F.col("known"), F.sequence(F.col("at"), F.col("at") + F.col("len") - 1))))
    return (
        hits.groupBy("rid", "doc_id", "n_words")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("known"), F.col("item_id").cast("string")))).alias("item_ids"),
            F.array_sort(F.array_distinct(spans)).alias("hit"),
        )
        .select("doc_id", "n_words", "item_ids", "hit")
    )


def _cands_by_set(base: DataFrame, grams: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """Candidate windows, with the grams as a hash set inside the plan."""
    parts = ["cast(array() as array<struct<at:int,len:int,body:string>>)"]
    for k in lengths:
        members = ", ".join(f"{r['g']}L" for r in grams.where(F.col("len") == k).select("g").collect())
        g = min(gram, k)
        parts.append(_scan_sql("size(w)", k, g, f"xxhash64(slice(w, p + 1, {g})) in ({members})"))
    # The array() around w computes the words once, however often the lambda uses them.
    packed = F.expr(f"transform(array(w), w -> named_struct('n_words', size(w), 'cands', concat({', '.join(parts)})))[0]")
    return base.select("rid", "doc_id", packed.alias("x")).select("rid", "doc_id", "x.*")


def _cands_by_join(base: DataFrame, grams: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """The same candidates with the grams in a table of any size; Spark picks the join."""
    looks = [
        f"transform(if(size(w) >= {k}, sequence(0, size(w) - {min(gram, k)}, {k - min(gram, k) + 1}), cast(array() as array<int>)), "
        f"p -> named_struct('len', {k}, 'p', p, 'g', xxhash64(slice(w, p + 1, {min(gram, k)}))))"
        for k in lengths
    ]
    keyed = base.select("rid", F.expr(f"transform(array(w), w -> concat({', '.join(looks)}))[0]").alias("x"))
    spots = keyed.select("rid", F.explode("x").alias("x")).select("rid", "x.*").join(grams, ["len", "g"], "left_semi")
    per_doc = spots.groupBy("rid").agg(F.collect_set(F.struct("len", "p")).alias("spots"))  # one document's positions at most
    parts = ["cast(array() as array<struct<at:int,len:int,body:string>>)"]
    for k in lengths:
        parts.append(_scan_sql("size(w)", k, min(gram, k), f"array_contains(spots, named_struct('len', {k}, 'p', p))"))
    packed = F.expr(f"transform(array(w), w -> named_struct('n_words', size(w), 'cands', concat({', '.join(parts)})))[0]")
    joined = base.join(per_doc, "rid", "left").withColumn("spots", F.coalesce("spots", F.array().cast("array<struct<len:int,p:int>>")))
    return joined.select("rid", "doc_id", packed.alias("x")).select("rid", "doc_id", "x.*")


def is_contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """Some word is hit, and at least one word in ``share``."""
    return (n_hit > 0) & (F.lit(share) * n_hit >= n_words)


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20) -> DataFrame:
    """``docs`` without the contaminated rows; other rows of the same id stay."""
    scratch = Scratch(docs.sparkSession, "decontaminate-drop")
    rows = docs.select(F.struct(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("h")).alias("row"), text_col)
    seen = scan(rows, benchmark, id_col="row", text_col=text_col)
    bad = scratch.save(seen.where(is_contaminated(F.size("hit"), F.col("n_words"), share)).select("doc_id.id", "doc_id.h").distinct())
    return without(docs, bad, id_col, text_col)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the normalised words that no benchmark window covers, joined by spaces.

    For documents whose ids are unique; one without words gives the empty text.
    """
    seen = scan(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(id_col), "hit")
    words = docs.select(id_col, word_list(F.col(text_col)).alias("w")).join(seen, id_col)
    clean = F.expr("transform(array(w), w -> array_join(filter(w, (x, i) -> not array_contains(hit, i)), ' '))[0]")
    return words.select(id_col, clean.alias("clean_text"))
