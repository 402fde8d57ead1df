import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import components, exact_dedup, ngram_join
from loomspark.llm.scratch import Scratch

DOC = "doc_id long, text string"
EDGE = [(1, None), (2, ""), (3, " \n"), (4, "a  b"), (5, "a\tb"), (6, "A b"), (7, None), (4, "a  b"), (9, "x" * 200_000), (None, "a b"), (None, "lonely")]


def test_exact_classes(spark):
    got = exact_dedup.classes(spark.createDataFrame([(i, t, "s") for i, t in EDGE], DOC + ", keep_id string")).collect()
    assert len(got) == len(EDGE)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in EDGE:
        groups.setdefault(norm(t), []).append(i)
    for body, ids in groups.items():
        rows = [r for r in got if r.text_sha256 == hashlib.sha256(body.encode()).hexdigest()]
        keep = min((i for i in ids if i is not None), default=None)
        assert len(rows) == len(ids) and {(r.keep_id, r.group_size) for r in rows} == {(keep, len(ids))}
        assert all(r.kept == (r.doc_id is not None and r.doc_id == keep) for r in rows)


def test_exact_deduplicate_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a  b", "y"), (3, "c", "z")], DOC + ", kept string")
    assert [tuple(r) for r in exact_dedup.deduplicate(docs).orderBy("doc_id").collect()] == [(1, "a b", "x"), (3, "c", "z")]
    assert exact_dedup.classes(docs.limit(0)).count() == 0 and exact_dedup.deduplicate(docs.limit(0)).count() == 0


def brute_groups(docs, width, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids = list(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    common = " ".join(rng.choices(words, k=60))
    bases = [" ".join(rng.choices(words, k=rng.randint(1, 250))) for _ in range(12)]
    out = []
    for i in range(n):
        w = rng.choice(bases).split()
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = rng.choice(words).upper()
        out.append((i + 1, " ".join(w) + (" " + common if rng.random() < 0.4 else "")))
    return out + [(900, ""), (901, None), (902, "one"), (903, "ONE"), (904, "one two"), (905, " one\ttwo "), (906, "one two three")]


@pytest.mark.parametrize(("width", "percent", "members"), [(3, 90, 2_000_000), (5, 80, 2_000_000), (3, 90, 1_500), (3, 80, 600)])
def test_groups_against_brute_force(spark, width, percent, members):
    docs = corpus(percent + members)
    got = ngram_join.groups(spark.createDataFrame(docs, DOC), width, percent, block_members=members).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(docs, width, percent)


def test_groups_with_repeated_and_null_ids(spark):
    docs = [(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "z z z"), (None, None)]
    got = ngram_join.groups(spark.createDataFrame(docs, DOC)).collect()
    assert len(got) == len(docs)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert ngram_join.groups(spark.createDataFrame([], DOC)).count() == 0


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "x"), (2, text + " end", "y"), (3, "other", "z"), (4, "", "e")], DOC + ", n string")
    assert [r.doc_id for r in ngram_join.one_of_each(docs).orderBy("doc_id").collect()] == [1, 3, 4]


def test_prefix_bounds_lose_nothing():
    rng = random.Random(5)
    for percent in (80, 90):
        for _ in range(300):
            n = rng.randint(1, 120)
            a = set(rng.sample(range(10_000), n))
            b = set(a)
            for _ in range(rng.randint(0, n // 5 + 1)):
                b.discard(rng.choice(sorted(a)))
                if rng.random() < 0.6:
                    b.add(rng.randrange(10_000))
            if not b or 100 * len(a & b) < percent * len(a | b):
                continue
            la, lb = (sorted(x)[: ngram_join.list_length(len(x), percent)] for x in (a, b))
            order = lambda v: (v * 7919 % 10_007, v)
            pa, pb = (sorted(x, key=order)[: ngram_join.prefix_length(len(s), percent)] for x, s in ((la, a), (lb, b)))
            assert set(pa) & set(pb)


def test_trees_agree_with_all_pairs():
    rng = np.random.default_rng(5)
    for trial in range(60):
        bases = [rng.integers(0, 10**6, rng.integers(1, 60)) for _ in range(3)]
        sets = []
        for _ in range(rng.integers(2, 25)):
            x = bases[rng.integers(0, 3)].copy()
            k = rng.integers(0, max(1, len(x) // 8) + 1)
            if k:
                x[rng.integers(0, len(x), k)] = rng.integers(0, 10**6, k)
            sets.append(np.unique(x))
        q = (90, 80)[trial % 2]
        tree = ngram_join.PrefixTree(sets, q, run=(256, 4)[trial % 3 == 0])
        tree.link()
        got = {i: int(tree.group[place]) for place, i in enumerate(tree.order)}
        names = {}
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= q * (len(sets[i]) + len(sets[j]) - k):
                    a, b = root[i], root[j]
                    root = [a if r == b else r for r in root]
        for i, r in enumerate(root):
            assert names.setdefault(r, got[i]) == got[i]
        assert len(set(names.values())) == len(names)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r.id: r.root for r in got} == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def test_queries_against_sql(spark, sf):
    from loomspark.llm.queries import op3_exact_dedup

    assert op3_exact_dedup(spark, sf).where(F.col("kept")).count() == 189
