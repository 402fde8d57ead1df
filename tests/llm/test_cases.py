"""Texts of a million characters, and columns named like those that the operators make."""

import random

import pytest
from pyspark.sql import functions as F
from test_texts import BYTES, DOC, WORDS, brute_contamination

from loomspark.llm import decontaminate, exact_dedup, hmm, ngram_join, packing, pii, quality, token_counts
from loomspark.llm.tokens import load

CLASHING = (
    "id", "a", "b", "n", "key", "list", "set", "block", "rid", "w", "words", "h", "row", "kept", "keep_id", "group_size", "body", "h128", "h256", "component_id", "n_shingles", "n_words", "hit",
    "item_ids", "item_id", "start", "length", "offset", "sequence_id", "ids_crc32", "doc_tokens", "n_bytes", "n_tokens", "over_limit", "spans", "n_email", "kind", "value", "term", "held_out", "n_known",
    "train_tokens", "base_score", "_h", "_id", "word", "c", "u", "x", "rank",
)


def texts():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    some = [" ".join(rng.choices(words, k=rng.randint(5, 40))) for _ in range(12)]
    return [(k, t) for k, t in enumerate([*some, some[0], some[1] + " tail", None, "", "call +1 202 555 0100 or a@b.org"])]


BENCH = [(1, " ".join(f"q{k}" for k in range(20))), (2, "w1 w2 w3")]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


OPERATORS = {
    "ngram_join": lambda d, b: ngram_join.groups(d),
    "one_of_each": lambda d, b: ngram_join.one_of_each(d, 5, 80).select("doc_id", "text"),
    "packing": lambda d, b: packing.pack(d, WORDS, end_id=2, width=4096).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
    "classes": lambda d, b: exact_dedup.classes(d),
    "deduplicate": lambda d, b: exact_dedup.deduplicate(d).select("doc_id", "text"),
    "pii": lambda d, b: pii.report(pii.find(d)),
    "token_counts": lambda d, b: token_counts.answers(d, BYTES, limit=512),
    "hmm": lambda d, b: hmm.score(d).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score")),
    "scan": lambda d, b: decontaminate.scan(d, b),
    "remove_documents": lambda d, b: decontaminate.remove_documents(d, b).select("doc_id", "text"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_change_nothing(spark, bench, name):
    plain = spark.createDataFrame(texts(), DOC)
    wide = plain.select("*", *[F.lit("clash").alias(c) for c in CLASHING])
    got, want = (sorted(map(repr, OPERATORS[name](d, bench).collect())) for d in (wide, plain))
    assert got == want and want


@pytest.mark.parametrize("keep", [exact_dedup.deduplicate, ngram_join.one_of_each])
def test_clashing_columns_are_kept(spark, keep):
    wide = spark.createDataFrame(texts(), DOC).select("*", *[F.lit("clash").alias(c) for c in CLASHING])
    kept = keep(wide)
    assert kept.columns == wide.columns and {r[c] for r in kept.collect() for c in CLASHING} == {"clash"}


def test_very_long_texts(spark, bench):
    rng = random.Random(5)
    long = " ".join(f"v{rng.randrange(50_000)}" for _ in range(150_000))  # a million characters
    passage = " ".join(f"Q{k}" for k in range(2, 18))
    near = long.replace(" ", "  ", 7) + " end"
    docs = [(1, long), (2, near), (3, long), (4, long[:700_000] + " " + passage), (5, "x" * 300_000)]
    frame = spark.createDataFrame(docs, DOC).repartition(5).cache()
    assert {r.doc_id: r.component_id for r in ngram_join.groups(frame).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert {r.doc_id: r.keep_id for r in exact_dedup.classes(frame).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    for r in decontaminate.scan(frame, bench).collect():
        n, hit, items = brute_contamination(docs[r.doc_id - 1][1], BENCH)
        assert (r.n_words, r.hit, r.item_ids) == (n, hit, items)
    tokenizer = load(WORDS)
    packed = packing.pack(frame, WORDS, end_id=2, width=4096).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    for r in packed:
        assert r.n == r["all"] == len(tokenizer.encode(docs[r.doc_id - 1][1], add_special_tokens=False).ids) + 1
    found = pii.report(pii.find(spark.createDataFrame([(1, long + " a@b.org " + long)], DOC))).first()
    assert found.n_email == 1
    scored = quality.score(frame, quality.train(frame, spark.createDataFrame([(1, 1)], "doc_id long, quality int")), out_col="s")
    assert scored.where("s between 0 and 1").count() == 5
