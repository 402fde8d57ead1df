import random

import pytest
from pyspark.sql import functions as F

from loomspark.config import PrepSettings, Source
from loomspark.functions import text as tx
from loomspark.functions.tokens import ByteTokenizer, batches
from loomspark.operators import pack
from loomspark.plans import prepare as prep
from loomspark.sources import documents as src
from test_config import settings

ARCHIVES = ("news", "forum")
SCHEMA = "file string, file_ord int, row long, content string, score double, metadata map<string,string>"
VAL = lambda text: F.struct(tx.fingerprint(text, 7, 0.1)["dedup_hash"].alias("dedup_hash"), F.when(text.startswith("val-"), "val").otherwise("train").alias("split"))


def rows(source, texts):
    return [("memory", 0, i, t, 1.0, {"fixture": source}) for i, t in enumerate(texts)]


def source_texts(source):
    return [f"val-{source}-000-" + "v" * 30] + [f"train-{source}-{k:03d}-" + source[0] * 30 for k in range(30)]


def greedy(sources, targets, split_of):
    """One document after the other, as a reader with one set of digests would do it."""
    seen, out = set(), []
    for name, texts in sources:
        used = dict.fromkeys(targets[name], 0)
        for i, t in enumerate(texts):
            h, split = tx.dedup_digest(t), split_of(t)
            if h in seen or used[split] >= targets[name][split]:
                continue
            n = len(t.encode()) + 2
            out.append((name, split, i, used[split], used[split] + n))
            used[split] += n
            seen.add(h)
    return sorted(out)


def build(spark, texts, **kw):
    s = PrepSettings.parse(settings())
    frames = {k: spark.createDataFrame(rows(k, v), SCHEMA) for k, v in texts.items()}
    return s, prep.prepare(spark, s, ByteTokenizer(), documents=frames, mark=VAL, **kw)


def test_accepts_what_a_reader_would(spark):
    texts = {k: source_texts(k) for k in ARCHIVES}
    texts["news"].insert(3, texts["news"][2])
    texts["news"].insert(5, "Ａ  Foo\tBAR")
    texts["forum"].insert(1, "a foo   bar")
    s, got = build(spark, texts)
    want = greedy(list(texts.items()), {k: {t: s.target(k, t) for t in ("train", "val")} for k in ARCHIVES}, lambda t: "val" if t.startswith("val-") else "train")
    assert sorted((r.source_id, r.split, r.row, r.start_token, r.end_token) for r in got.collect()) == want
    assert not got.where("content = 'a foo   bar'").count()


def test_acceptance_against_a_simulation_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [f"src{k}" for k in range(6)]
    plain = {n: [] for n in names}
    for r in docs.orderBy("doc_id").collect():
        if r.source in plain:
            plain[r.source].append(r.text)
    plain["src1"][0:0] = plain["src0"][:3]  # copies across sources, some of them dropped by a full split
    plain["src3"].append(plain["src0"][-1])
    targets = {n: {"train": 9_000, "val": 4_000} for n in names}
    split = lambda t: "val" if tx.in_validation(tx.normalize(t), 42, 0.3) else "train"
    parts = []
    for n in names:
        frame = spark.createDataFrame([(0, i, t) for i, t in enumerate(plain[n])], "file_ord int, row long, content string")
        marked = frame.withColumn("f", tx.fingerprint(F.col("content"), 42, 0.3))
        parts.append((n, marked.select("file_ord", "row", "f.*", ByteTokenizer.length_column(F.col("content")).alias("n_tokens"))))
    want = greedy(list(plain.items()), targets, split)
    got = pack.accept_sources(parts, targets)
    assert sorted((r.source_id, r.split, r.row, r.start_token, r.end_token) for r in got.collect()) == want
    together = None
    for k, (n, p) in enumerate(parts):
        p = p.withColumns({"source_id": F.lit(n), "source_ord": F.lit(k)})
        together = p if together is None else together.unionByName(p)
    table = spark.createDataFrame([(n, t, v) for n in names for t, v in targets[n].items()], "source_id string, split string, target long")
    again = pack.accept_all(together, table)
    assert sorted((r.source_id, r.split, r.row, r.start_token, r.end_token) for r in again.collect()) == want


def test_short_source_raises(spark):
    with pytest.raises(ValueError, match="budget"):
        build(spark, {"news": source_texts("news")[:4], "forum": source_texts("forum")})


def test_resume_reads_finished_steps_only(spark, tmp_path):
    texts = {k: source_texts(k) for k in ARCHIVES}
    s, first = build(spark, texts, work=str(tmp_path))
    want = sorted(r.content_hash for r in first.collect())

    def never(text):
        raise AssertionError("a finished step was computed again")

    frames = {k: spark.createDataFrame(rows(k, v), SCHEMA) for k, v in texts.items()}
    again = prep.prepare(spark, s, ByteTokenizer(), documents=frames, mark=never, work=str(tmp_path))
    assert sorted(r.content_hash for r in again.collect()) == want
    other = PrepSettings.parse(settings(validation_tokens_per_source=41))
    with pytest.raises(ValueError, match="resumed"):
        prep.prepare(spark, other, ByteTokenizer(), documents=frames, mark=VAL, work=str(tmp_path))


def test_manifest_export_and_verification(spark, tmp_path):
    s, got = build(spark, {k: source_texts(k) for k in ARCHIVES})
    got = got.cache()
    shards = prep.export_shards(got, ByteTokenizer(), 37, str(tmp_path / "out"), by_file=False).cache()
    m = prep.manifest(s, ByteTokenizer(), got, shards)
    prep.check_manifest(m)
    assert m["splits"]["train"]["tokens"] == got.where("split = 'train'").agg(F.sum("n_tokens")).first()[0]
    assert prep.verify_shards(spark, m, str(tmp_path / "out")).count() == 0
    stream = b"".join((tmp_path / "out" / h["path"]).read_bytes() for h in m["sources"][0]["splits"]["train"]["shards"])
    texts = [r.content for r in got.where("source_id = 'news' and split = 'train'").orderBy("start_token").collect()]
    want = [t for x in ByteTokenizer().encode_batch(texts, True, True) for t in x]
    assert [int.from_bytes(stream[i : i + 2], "little") for i in range(0, len(stream), 2)] == want
    victim = tmp_path / "out" / m["sources"][0]["splits"]["train"]["shards"][1]["path"]
    victim.write_bytes(b"\0" * victim.stat().st_size)
    assert [r.problem for r in prep.verify_shards(spark, m, str(tmp_path / "out")).collect()] == ["hash"]
    broken = m | {"documents": m["documents"] + 1}
    with pytest.raises(ValueError):
        prep.check_manifest(broken)
    prep.save_manifest(m, tmp_path / "out", tmp_path / "final")
    assert (tmp_path / "final" / "manifest.json").exists()
    index = prep.document_index(got).collect()
    assert {r.metadata["file"] for r in index} == {"memory"} and all(len(r.dedup_hash) == 32 for r in index)
    assert prep.journal(got, ARCHIVES).count() == got.count()
    got.unpersist()
    shards.unpersist()


def test_files_close_shards(spark):
    docs = spark.createDataFrame([("a", "train", 0, 0, 0, 30, 30), ("a", "train", 0, 1, 30, 50, 20), ("a", "train", 1, 0, 50, 90, 40)], "source_id string, split string, file_ord int, row long, start_token long, end_token long, n_tokens long")
    by_file = pack.shard_table(pack.shard_segments(docs, 37, True)).orderBy("shard").collect()
    assert [r.tokens for r in by_file] == [37, 13, 37, 3]
    memory = pack.shard_table(pack.shard_segments(docs, 37, False)).orderBy("shard").collect()
    assert [r.tokens for r in memory] == [37, 37, 16] and [r.end for r in memory] == [37, 74, 90]


def test_scan_projects_filters_and_checks(spark, tmp_path):
    spec = Source("s", "r", str(tmp_path / "data"), "content", score_column="score", language_column="lang", min_score=0.5, language="en", metadata_columns={"origin": "url", "raw": "blob"})
    data = [("ok text", "0.9", "en", "u1", b"a\xffb", 1), ("low text", "0.1", "en", "u2", None, 2), ("nan text", "nan", "en", None, None, 3), ("none", None, "en", "u4", None, 4), ("german", "1", "de", "u5", None, 5), (None, "1", "en", "u6", None, 6), ("", "1", "en", "u7", None, 7), ("x", "1_0", "en", "u8", None, 8)]
    spark.createDataFrame(data, "content string, score string, lang string, url string, blob binary, unused int").coalesce(1).write.parquet(str(tmp_path / "data" / "part"))
    files = src.discover(spark, spec, 42)
    got = src.scan(spark, spec, files, 2, 100)
    assert [(r.content, r.row) for r in got.orderBy("row").collect()] == [("ok text", 0), ("nan text", 2)]
    assert got.orderBy("row").first().metadata == {"origin": "u1", "raw": "a�b"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "PushedFilters" in plan and "EqualTo(lang,en)" in plan
    bad = spark.createDataFrame([("text", "abc", "en", "u", None, 1)], "content string, score string, lang string, url string, blob binary, unused int")
    with pytest.raises(Exception, match="non-numeric score at row 0"):
        src.in_memory(bad.withColumn("i", F.lit(0)), spec, "i", 0, 100).collect()
    with pytest.raises(ValueError, match="lack"):
        src.check_schema(bad.drop("lang").schema, spec)
    with pytest.raises(ValueError, match="text"):
        src.check_schema(bad.withColumn("content", F.lit(1)).schema, spec)


def test_listing_is_seeded():
    spec = Source("s", "r", "", "text")
    names = [f"f{k}.parquet" for k in range(9)] + ["skip.txt", "UP.PARQUET", "f1.parquet"]
    a, b = src.ordered(spec, names, 1), src.ordered(spec, list(reversed(names)), 1)
    assert a == b and sorted(a.paths) == sorted({n for n in names if n.lower().endswith("parquet")})
    assert src.ordered(spec, names, 2).paths != a.paths
    with pytest.raises(ValueError):
        src.ordered(spec, ["x.txt"], 1)


def test_text_identity(spark):
    odd = ["Ａ  Foo\tBAR", "a foo   bar", " x\x1cy\x85z　w ", "", "ẞ İ Σ"]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select("t", tx.fingerprint(F.col("t"), 7, 0.5).alias("f"), tx.normalize_native(F.col("t")).alias("n")).collect()
    for r in got:
        assert bytes(r.f.dedup_hash) == tx.dedup_digest(r.t)
        assert (r.f.split == "val") == tx.in_validation(tx.normalize(r.t), 7, 0.5)
    assert got[0].f.dedup_hash == got[1].f.dedup_hash
    assert got[2].n == tx.normalize(odd[2]) == "x y z w"


def test_batches_hold_both_bounds():
    rng = random.Random(1)
    texts = ["x" * rng.randint(0, 50) for _ in range(500)]
    runs = list(batches(texts, 7, 100))
    assert [t for r in runs for t in r] == texts
    assert all(len(r) <= 7 and (sum(map(len, r)) <= 100 or len(r) == 1) for r in runs)


def test_token_range(spark):
    tokens = list(range(100))
    cuts = [0, 7, 7, 40, 99, 100]
    frame = spark.createDataFrame([("a", "train", a, tokens[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], "source_id string, split string, start_token long, tokens array<int>")
    for start, count in ((0, 100), (5, 3), (6, 60), (98, 2)):
        assert pack.read_tokens(frame, start, count).first().tokens == tokens[start : start + count]
