import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import decontaminate, hmm, packing, pii, quality, reply_trees, site_tree, token_counts
from loomspark.llm.queries import ORACLE_SQL, QUERIES
from loomspark.llm.tokens import WordIds, load, path

DOC = "doc_id long, text string"
BYTES, WORDS = path("byte_bpe_50k.json"), path("word_bpe_49k.json")
ODD = [
    "", "  a  b\t \n c\r\n\r\n d\xa0 e \x1ca!\x1cb \x1c c", "it's 're  'r we'll x<|endoftext|>y <|endoft <|endoftext|>", "　 a   b\x85 c", "a" * 500,
    "\U0001f600 é é \n\n\n  ", "'r 'v'e 12345 !!!??? \t\t x   ", "<|startoftext|>İΣß ﬁ Ａ",
]


def odd_texts(n=400):
    rng = random.Random(3)
    alphabet = " \n\t\r\x0b\x1c\x85\xa0aAé1'!<|r　"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"pipeline"}))
def test_queries_against_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, (tuple(r[k] for k in at) for r in want.fetchall())))


# --- tokens ---------------------------------------------------------------------------------------


def test_word_ids_equal_the_library():
    words, tokenizer = WordIds(WORDS), load(WORDS)
    for t in odd_texts():
        assert np.frombuffer(words.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_prefix_counts_equal_the_library():
    prefixes, tokenizer = token_counts.Prefixes(BYTES), load(BYTES)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for t in odd_texts(150):
        table = prefixes.table(t)
        counts = [count(t[:i]) for i in range(len(t) + 1)]
        assert table.total == counts[-1]
        assert [table.count_at(i) for i in range(len(t) + 1)] == counts
        assert table.everywhere() == counts[1:]
        for budget in (0, 1, 3, 7):
            assert table.longest_within(budget) == max(i for i, c in enumerate(counts) if c <= budget)


def test_counts_come_from_the_tables(sf):
    """Once the merges are read, nothing is encoded: counts are last entries of prefix tables."""
    import pyarrow.parquet as pq

    class NoEncoder:
        pre_tokenizer = load(BYTES).pre_tokenizer

    prefixes = token_counts.Prefixes(BYTES)
    prefixes.tokenizer = NoEncoder
    texts = odd_texts(150) + pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    want = [len(e.ids) for e in load(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [prefixes.table(t or "").total for t in texts] == want
    piece = " unbelievably"
    table = prefixes.piece(token_counts.as_bytes(piece))
    assert table == [len(load(BYTES).encode(piece[:i], add_special_tokens=False).ids) for i in range(len(piece) + 1)] and prefixes.plain(piece) == table[-1]


def test_token_answers(spark):
    rows = [(1, None), (2, ""), (3, "word " * 600), (4, "ab"), (4, "ab"), (None, "é")]
    got = token_counts.answers(spark.createDataFrame([(i, t, 0) for i, t in rows], DOC + ", n_tokens int"), BYTES, 512).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got)[:2] == [(0, 0, False)] * 2 and len(got) == 6
    assert [r.chars_within_limit for r in got if r.doc_id == 3] == [len("word" + " word" * 511)]
    tables = token_counts.prefix_tables(spark.createDataFrame([(1, "one two")], DOC), BYTES).first()
    assert tables.ends == [3, 7] and tables.counts == [1, 2]
    every = token_counts.prefix_tables(spark.createDataFrame([(1, "one two")], DOC), BYTES, every=True).first()
    assert every.ends == list(range(1, 8)) and every.counts[2] == 1 and every.counts[-1] == 2
    assert token_counts.answers(spark.createDataFrame([], DOC), BYTES, 512).count() == 0


def test_packing_is_a_partition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "long word " * 9_000), (-4, "same"), (-4, "same")], DOC))
    got = packing.pack(docs, WORDS, 2, 4096).collect()
    words, pieces, ids = WordIds(WORDS), {}, {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append(words.ids(r.text or "") + (2).to_bytes(4, "little"))
    for r in got:
        raw = ids[r.doc_id][0]
        assert r.doc_tokens == len(raw) // 4 and r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, found in pieces.items():
        assert sorted(x for s, n in found for x in range(s, s + n)) == sorted(x for raw in ids[doc] for x in range(len(raw) // 4))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in sequences.values():
        end = 0
        for offset, n in sorted(found):
            assert offset == end
            end += n
        assert end <= 4096
    total = sum(r.length for r in got)
    assert total / (4096 * len(sequences)) > 0.9
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_plan_uses_up_the_histogram():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randint(1, 64): rng.randint(1, 900) for _ in range(rng.randint(1, 30))}
        used = Counter()
        for pattern, times in packing.plan(histogram, 64):
            assert sum(b * m for b, m in pattern.items()) <= 64
            for b, m in pattern.items():
                used[b] += m * times
        assert used == Counter(histogram)


def test_nnls_solves():
    rng = np.random.default_rng(1)
    a, x = rng.random((30, 12)), np.maximum(rng.normal(size=12), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


# --- decontamination ------------------------------------------------------------------------------


def brute_contamination(text, items, n=13):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))) if w]
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(n, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1 if windows else 0):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                names |= {str(name)} if name is not None else set()
    return len(w), sorted(hit), sorted(names)


@pytest.mark.parametrize("max_grams", [50_000, 0])
def test_scan_against_brute_force(spark, max_grams):
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "x1", "Ünder"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 6, 12, 13, 14, 30])))) for k in range(12)] + [(50, None), (51, ""), (None, "null item words here"), (52, "délta, x1!")]
    items = [x for x in items if len((x[1] or "").split()) != 1]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(60)] + [(100, items[1][1] + "; tail"), (101, None), (102, ""), (103, "NULL-item.words here"), (103, "NULL-item.words here")]
    got = decontaminate.scan(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"), max_grams=max_grams).collect()
    assert len(got) == len(docs)
    want = {i: brute_contamination(t, items) for i, t in docs}
    for r in got:
        assert (r.n_words, r.hit, r.item_ids) == want[r.doc_id], r.doc_id


def test_decontaminating(spark):
    bench = spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(20)))], "item_id long, text string")
    passage = " ".join(f"Q{k}" for k in range(3, 18))
    docs = spark.createDataFrame([(1, passage + " and more"), (2, "clean text"), (3, passage + " w" * 600), (4, None)], DOC)
    assert sorted(r.doc_id for r in decontaminate.remove_documents(docs, bench).collect()) == [2, 3, 4]
    assert {r.doc_id: r.clean_text for r in decontaminate.remove_spans(docs, bench).collect()}[1] == "and more"
    none = bench.limit(0)
    assert all(r.hit == [] for r in decontaminate.scan(docs, none).collect()) and decontaminate.scan(docs.limit(0), bench).count() == 0


# --- personal data --------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "card":
        total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or (all(int(p) <= 255 for p in match.split(".")) if kind == "ip" else 9 <= len(digits) <= 15)


def test_base_spans_against_re(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [
        (-1, None), (-2, ""), (-3, "a@b.co_x@d.com a.b@c@d.ef x@y.z.@q.w 😀é@é a@b.c1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 4111-1111-1111-1111x +1 (555) 123-4567 +12345678 +1..2"),
        (-4, "a" * 50_000), (-5, "a." * 20_000 + "@" + "b." * 20_000), (-6, "1 " * 20_000), (-7, "x@y.zz " * 3_000), (-8, "+1 " + "(" * 20_000), (-9, "@a.b @@a@b.c@d.e"),
    ]
    for r in pii.report(pii.find(spark.createDataFrame(rows, DOC))).collect():
        text = dict(rows)[r.doc_id] or ""
        spans = {k: [m.span() for m in re.finditer(p, text, re.A) if valid(k, m.group())] for k, p in PATTERNS.items()}
        base = ",".join(f"{k}:{a}:{b}" for k, x in spans.items() for a, b in x)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in spans.values()]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)


def test_terms_that_give_values_away(spark):
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choices(["some", "words", "that", "all", "texts", "have"], k=20))
    docs = [(k, f"{filler()} write to our zanzibar office boss@corp.example today {filler()}") for k in range(5)]
    docs += [(10 + k, f"{filler()} office today write {filler()}") for k in range(40)]
    found = {r.doc_id: r for r in pii.report(pii.find(spark.createDataFrame(docs, DOC))).collect()}
    text = docs[0][1]
    at = text.index("zanzibar")
    assert f"term:{at}:{at + 8}" in found[0].spans and all("office" not in text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in found[0].spans.split(","))
    assert all(found[10 + k].spans == "" for k in range(40))
    clean = {r.doc_id: r.clean_text for r in pii.sanitise(spark.createDataFrame(docs, DOC)).collect()}
    assert "[EMAIL]" in clean[0] and "zanzibar" not in clean[0] and clean[10] is None
    copies = [(k, docs[0][1]) for k in range(30)]  # copies of one text prove nothing
    assert all("term" not in r.spans for r in pii.report(pii.find(spark.createDataFrame(copies + docs[10:], DOC))).collect())
    assert pii.report(pii.find(spark.createDataFrame([], DOC))).count() == 0


def brute_terms(docs, alpha=0.9):
    """Terms by document from counts over whole, different texts."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = {t: {w for w in map(str.lower, word.findall(t)) if len(w) >= 3 and not w.isdigit()} for t in {t or "" for _, t in docs}}
    values = {t: {(k, m.group().lower()) for k, p in PATTERNS.items() for m in re.finditer(p, t, re.A) if valid(k, m.group())} for t in words}
    n_t, n_e = Counter(w for ws in words.values() for w in ws), Counter(e for es in values.values() for e in es)
    n_et, n = Counter((e, w) for t, es in values.items() for e in es for w in words[t]), len(words)
    gives = lambda e, w: n_e[e] < n and math.log2(n * (n_et[e, w] - 0.5) / (n_e[e] * n_t[w])) >= alpha * math.log2(n / n_e[e])
    return {i: {w for w in words[t or ""] if any(gives(e, w) for e in values[t or ""])} for i, t in docs}


def test_rare_values_and_far_terms(spark):
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choices(["some", "words", "that", "all", "texts", "have"], k=n))
    docs = [(1, f"yeti {filler(80)} write to one@corp.example {filler(3)}")]  # one text, and a term 80 words away
    docs += [(2 + k, f"{filler(30 + k)} two@corp.example or 10.1.2.3 {filler(60)} kraken") for k in range(2)]
    docs += [(10 + k, f"{filler(40)} ten@corp.example {filler(40)} {'griffin' if k < 9 else 'sphinx'} c{k}") for k in range(10)]
    docs += [(100 + k, f"{filler(20)} n{k // 3} {'griffin' if k < 6 else ''}") for k in range(1500)] + [(1, docs[0][1])]
    found = pii.report(pii.find(spark.createDataFrame(docs, DOC))).collect()
    texts, want = dict(docs), brute_terms(docs)
    assert len(found) == len(docs) and "yeti" in want[1] and "kraken" in want[2] and "griffin" not in want[10] and "sphinx" not in want[19] and "sphinx" not in want[10] and "ten" in want[10]
    for r in found:
        spans = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("term:")]
        assert {texts[r.doc_id][a:b] for a, b in spans} == {w for w in want[r.doc_id] if w not in ("one", "two", "ten", "corp", "example")}


# --- conversations --------------------------------------------------------------------------------


def test_trees_rank_and_format(spark):
    nodes = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good <|end|>\n\\l", 0.9), (1, 4, 3, "user", None, 0.9), (2, 5, 99, None, "orphan", None), (3, 6, 7, "user", "ring", 1.0), (3, 7, 6, "user", "ring", 1.0), (3, 8, 7, "user", "on a ring", 1.0)]
    frame = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double").na.fill("")
    done = reply_trees.read_back(reply_trees.format_paths(frame)).collect()
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.learned) for r in done}
    assert got == {1: ([("user", "hi"), ("assistant", "good <|end|>\n\\l"), ("user", "")], "good <|end|>\n\\l"), 2: ([("", "orphan")], "")}
    both = reply_trees.format_paths(frame, keep=2).where("conv_id = 1").orderBy("branch").collect()
    assert [r.n_turns for r in both] == [3, 2]


def test_escapes_read_back(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("\\l<|>end\ntxur/ ") for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["<|end|>", "<", "\\", "<|", "\\\\l|", "|"]
    rows = [(k, 0, "user", texts[k]) for k in range(len(texts))] + [(k, 1, "assistant", texts[-1 - k]) for k in range(len(texts))]
    done = reply_trees.read_back(reply_trees.format_paths(reply_trees.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    for r in done.collect():
        assert [t.text for t in r.turns] == [texts[r.conv_id], texts[-1 - r.conv_id]] and r.learned == texts[-1 - r.conv_id]


def test_long_thread(spark):
    rows = [(5, k, "assistant" if k % 2 else "user", f"m{k}") for k in range(300)] + [(None, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in reply_trees.read_back(reply_trees.format_paths(reply_trees.threads(frame))).collect()}
    assert [t.text for t in got[5].turns] == [f"m{k}" for k in range(300)] and got[5].learned == "".join(f"m{k}" for k in range(1, 300, 2))
    assert reply_trees.format_paths(reply_trees.threads(frame.limit(0))).count() == 0


# --- pages ----------------------------------------------------------------------------------------


def test_blocks():
    html = "<div class='siteNotice'>x</div><ul><li>a<li>b</ul><p>one<b>two</b><p>three &amp;nbsp; &lt;x&gt;<!-- <p>c</p> --><table><tr><td>1<td>2</table><div id=c1 class='entry-comments'>bad<p>bad2</p></div>tail<br>end<a"
    assert site_tree.main_text(html).split("\n") == ["a", "b", "onetwo", "three &nbsp; <x>", "1", "2", "tail end"]
    assert site_tree.blocks(None)[1] == [] and site_tree.blocks("<script>var t='</p>'</script><style>p{}")[1] == []
    assert site_tree.main_text("<nav>n</nav><article><header><h1>T</h1></header><p>a&#39;b<form>f</form></article><footer>f</footer>") == "T\na'b"
    wrapped = "<body class='nav-menus no-sidebar'><div class='sidebar-wrap'><main><div class='entry-header'><h1>T</h1></div><p>x</p><section class='comments'><article>bad</article></section></main></div>"
    assert site_tree.main_text(wrapped) == "T\nx"
    assert site_tree.blocks("<a " * 20_000) is not None
    doubtful = "<article><p>a</p><div class='widget-review'>b</div><p class='follow'>c</p></article><div class='related'>d</div>"
    assert site_tree.main_text(doubtful) == "a\nb\nc"  # a name alone doesn't take text out of an article
    deep = site_tree.blocks("<div>x" * 20_000)[0]
    assert len(site_tree.digests(deep)) == 20_001


def test_importance_against_brute_force(spark):
    """Entropies by hand, over whole nested pages."""
    rng = random.Random(4)
    piece = lambda k: rng.choice([f"<p>menu {k % 2}</p>", "<ul><li>home</li><li>news</li></ul>", f"<div class='b'><p>{rng.random()}</p></div>", f"plain {k % 3}"])
    pages = [(k, f"http://{'ab'[k % 2]}.example/{k}", "<body>" + "".join(piece(k) for _ in range(rng.randint(1, 4))) + "</body>") for k in range(40)] + [(50, "http://a.example/", None)]
    pages.append((51, pages[0][1], pages[0][2]))  # a copy counts once
    seen = {}
    for host, html in {(url.split("/")[2], html) for _, url, html in pages}:

        def nested(node):
            parts = [p if isinstance(p, str) else (p.name, nested(p)) for p in node.parts]
            return tuple(p for p in parts if isinstance(p, str) or p[1])

        def visit(node, path, host=host):
            seen.setdefault((host, node.key), []).append((nested(node), tuple("#" if isinstance(p, str) else p[0] for p in nested(node))))
            for c in node.children.values():
                if nested(c):
                    visit(c, (*path, c.name))

        root = site_tree.blocks(html)[0]
        for c in root.children.values():
            if nested(c):
                visit(c, (c.name,))

    def entropy(values):
        n = len(values)
        return 1.0 if n == 1 else -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n)

    counts = site_tree.branch_counts(spark.createDataFrame(pages, "page_id long, url string, html string"), "url", "html")
    got = {(r.host, r.path): (r.pages, r.importance) for r in site_tree.importance(counts).collect()}
    assert set(got) == set(seen)
    for k, values in seen.items():
        assert got[k] == (len(values), pytest.approx(0.9 * entropy([v[0] for v in values]) + 0.1 * entropy([v[1] for v in values])))


def test_low_branches_go(spark):
    page = lambda k: f"<div class='top'>Our site, all rights</div><div class='story'><p>story number {k} {'word' * k}</p></div>"
    rows = [(k, "http://h.example/" + str(k), page(k)) for k in range(8)] + [(20, None, None), (21, "http://h.example/0", page(0)), (22, "http://other.example/", page(1)), (23, "http://h.example/9", "<div class='top'>Our site, all rights</div>")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    for keys in (200_000, 0):
        got = {r.page_id: r for r in site_tree.extract(frame, max_keys=keys).collect()}
        assert len(got) == len(rows) and got[3].text == "story number 3 wordwordword" and got[20].text == "" and got[23].n_chars == 0
        assert got[22].text.startswith("Our site")  # one page is no tree
    assert site_tree.extract(frame.limit(0)).count() == 0


def test_tree_decides_on_marked_pages(spark):
    box = "<div>Read our app</div>"
    inside = lambda k: f"<body><main>{box}<p>story number {k}</p></main></body>"
    teaser = lambda k: f"<body><article><p>More from us</p></article><div><p>body number {k}</p></div></body>"
    rows = [(k, f"http://in.example/{k}", inside(k)) for k in range(6)] + [(10 + k, f"http://out.example/{k}", teaser(k)) for k in range(6)]
    rows += [(20, "http://few.example/", inside(0)), (21, "http://less.example/", teaser(0))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for keys in (200_000, 0):
        got = {r.page_id: r.text for r in site_tree.extract(frame, max_keys=keys).collect()}
        assert all(got[k] == f"story number {k}" and got[10 + k] == f"body number {k}" for k in range(6))
        assert got[20] == "Read our app\nstory number 0" and got[21] == "More from us"  # one page is no tree


def test_article_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    from html import unescape

    for r in QUERIES["op4_site_tree"](spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = [" ".join(unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


# --- scores ---------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op10_quality"](spark, sf).collect()]
    assert len(got) == 1_000 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in tested) / len(tested) > 0.93


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "text here", "q"), (None, "x", "q"), (3, "text here", "q")], DOC + ", score string")
    for labels in ([], [(1, 1), (3, 1), (3, None), (None, 0)]):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        out = quality.score(docs, model).collect()
        assert len(out) == 5 and len({round(r.quality_score, 12) for r in out}) == 1
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_keeps_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a text", 7, 8.0), (2, None, 7, 8.0)], "doc_id long, text string, __quality int, quality_score double")
    model = quality.AdditiveModel()
    assert [tuple(r) for r in quality.keep_good(frame, model).orderBy("doc_id").collect()] == [(1, "a text", 7, 8.0), (2, None, 7, 8.0)]
    assert [r.quality_score for r in quality.score(frame, model).collect()] == [0.5, 0.5]
    assert quality.keep_good(frame.limit(0), model).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4_000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x[:3_000], y[:3_000])
    assert (0, 3) in model.pairs and ((model.score(x[3_000:]) > 0.5) == y[3_000:]).mean() > 0.9


def naive(model, ids):
    """Likelihood, state probabilities and expected moves, with no scaling."""
    a, b = [model.start * model.emit[ids[0]]], [np.ones(len(model.start))]
    for i in ids[1:]:
        a.append((a[-1] @ model.move) * model.emit[i])
    for i in reversed(ids[1:]):
        b.insert(0, model.move @ (model.emit[i] * b[0]))
    p = a[-1].sum()
    pairs = sum((np.outer(a[t], model.emit[i] * b[t + 1]) * model.move / p for t, i in enumerate(ids[1:])), np.zeros(model.move.shape))
    return p, np.array(a) * np.array(b) / p, pairs


@pytest.mark.parametrize("segment", [1, 3, 8, 2048])
def test_expected_counts_are_exact(segment):
    """Cuts lose nothing."""
    rng = np.random.default_rng(2)
    model = hmm.first_model(np.array([0.4, 0.3, 0.2, 0.06, 0.04]), 3)
    model.move[:], model.start[:] = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
    texts = [model.symbols(rng.integers(-1, 3, n).astype(np.int32)) for n in [0, 0, 1, 2, 3, 7, 8, 9, 16, 17, 40, *rng.integers(0, 30, 20)]]
    start, pairs, emit, ll, sweep = hmm.expected_counts(model, texts, segment)
    want = [naive(model, x) for x in texts]
    assert start == pytest.approx(sum(g[0] for _, g, _ in want), rel=1e-4) and ll == pytest.approx(sum(math.log(p) for p, _, _ in want), rel=1e-5)
    assert pairs == pytest.approx(sum(m for _, _, m in want), rel=1e-4)
    counts = np.zeros(model.emit.shape)
    for x, (_, g, _) in zip(texts, want, strict=True):
        np.add.at(counts, x, g)
    assert emit == pytest.approx(counts, rel=1e-4, abs=1e-5)
    assert hmm.Sweep(model, texts, model.emit, segment).forward() == pytest.approx([math.log(p) for p, _, _ in want], rel=1e-5)


def test_baum_welch_raises_the_likelihood(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counts = hmm.word_counts(docs).where("word is not null").orderBy(F.desc("c"), "word").limit(500).collect()
    c = np.array([r.c for r in counts], float)
    numbered = hmm.number_words(docs, [bytes(r.word) for r in counts]).cache()
    unigram = np.concatenate([c, [10_000, 200]]) / (c.sum() + 10_200)
    model, seen = hmm.first_model(unigram, 4), []
    for _ in range(4):
        model, ll, _ = hmm.m_step(hmm.e_step(numbered, model), model, unigram)
        seen.append(ll)
    assert seen == sorted(seen)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)


def test_hmm_against_brute_force(spark):
    """Training and scores, with emissions for the words that travel and for those that don't, worked out one token at a time."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("a b c d".split()) if rng.random() < 0.7 else f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(61, None), (62, "never seen"), (62, "never seen")]
    said = [(i, (t or "").split()) for i, t in rows]
    learn = [ws for i, ws in said if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in learn for w in ws)
    n, share, states, passes = sum(c.values()) + len(learn), 0.02, 3, 3
    top = sorted((w for w in c if c[w] >= share * n), key=lambda w: (-c[w], w))
    assert 0 < len(top) < len(c)
    rest, kinds = sum(c.values()) - sum(c[w] for w in top), len(c) - len(top)
    unigram = np.array([*(c[w] for w in top), rest + 1, len(learn) + 1], float)
    unigram /= unigram.sum()
    model, at = hmm.first_model(unigram, states), {w: k for k, w in enumerate(top)}
    ids = lambda ws: [at.get(w, len(top)) for w in ws] + [len(top) + 1]
    for _ in range(passes):
        start, pairs, emit, tail = np.ones(states), np.ones((states, states)), 50 * unigram[:, None] * np.ones(states), {}
        for ws in learn:
            _, g, moves = naive(model, ids(ws))
            start, pairs = start + g[0], pairs + moves
            np.add.at(emit, ids(ws), g)
            for w, row in zip(ws, g, strict=False):
                if w not in at:
                    tail[w] = tail.get(w, 0) + row
        model = hmm.Hmm(start / start.sum(), pairs / pairs.sum(1, keepdims=True), emit / emit.sum(0))
    used = sum(tail.values())
    within = {w: ((g / (used / used.sum()) + c[w]) / 2 + 1) / (rest + kinds + 1) for w, g in tail.items()}
    assert sum(within.values()) + 1 / (rest + kinds + 1) == pytest.approx(np.ones(states))
    got = hmm.score(spark.createDataFrame(rows, DOC), states=states, share=share, passes=passes).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    for i, ws in said:
        p = model.start
        for k, w in enumerate([*ws, None]):
            p = p if k == 0 else p @ model.move
            s = len(top) + 1 if w is None else at.get(w, len(top))
            p = p * model.emit[s] * (within.get(w, np.full(states, 1 / (rest + kinds + 1))) if s == len(top) else 1)
        assert by[i] == pytest.approx(math.log10(p.sum()), rel=1e-4)


def test_scores_against_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "neverseen words"), (-3, "neverseen words")], DOC))
    rows = docs.collect()
    said = [(r.doc_id, hmm.words_of(r.text)) for r in rows]
    training = [w for i, w in said if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in training for w in ws)
    n, v = sum(c.values()) + len(training), len(c) + 1
    for share in (1e-6, 1e-3):
        got = hmm.score(docs.withColumn("word", F.lit(1)).withColumn("rid", F.lit(1)), states=4, passes=2, share=share).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        for i, ws in said:
            r = by[i]
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(training) + 1) / (n + v + 1))
            assert r.base_score == pytest.approx(base) and (r.n_tokens, r.train_tokens) == (len(ws) + 1, n)
            assert r.n_known == 1 + sum(c[w] > 0 for w in ws) and r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        per_token = lambda k: sum(r[k] for r in got) / sum(r.n_tokens for r in got)  # noqa: E731, B023
        assert per_token("score") > per_token("base_score")
    assert hmm.score(docs.limit(0), states=2, passes=1).count() == 0


# --- pipeline -------------------------------------------------------------------------------------


def test_stages_tell_rows_of_one_id_apart(spark):
    from loomspark.llm import exact_dedup, ngram_join

    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (2, a.replace(" ", "  ")), (2, b), (2, b), (3, "c"), (None, b), (None, "d"), (None, "d")]
    key = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert key(exact_dedup.deduplicate(spark.createDataFrame(rows, DOC))) == sorted([(1, a), (2, b), (3, "c"), (None, "d")], key=repr)
    near = [(1, a), (2, a + " more"), (2, b), (2, b), (3, "c"), (None, b + " more"), (None, "d")]
    assert key(ngram_join.one_of_each(spark.createDataFrame(near, DOC), 5, 80)) == sorted([(1, a), (2, b), (3, "c"), (None, "d")], key=repr)
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    left = decontaminate.remove_documents(spark.createDataFrame([(1, a), (1, b), (None, a), (None, b), (2, "c")], DOC), bench)
    assert key(left) == sorted([(1, b), (None, b), (2, "c")], key=repr)


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline
    from test_dedup_join import brute_groups

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf).cache())
    rows = [{r.doc_id: r.text for r in k.select("doc_id", *(["text"] if "text" in k.columns else [F.lit("").alias("text")])).collect()} for k in kept]
    assert all(k.columns == docs.columns for k in kept[:5])
    good, exact, near, clean, packed = rows[1:]
    first = {}
    for i, t in sorted(good.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert set(exact) == set(first.values())
    groups = brute_groups(list(exact.items()), 5, 80)
    assert set(near) == {i for i, (_, root) in groups.items() if i == root}
    for i, t in near.items():
        n, hit, _ = brute_contamination(t, items)
        assert (i in clean) == (not (hit and 20 * len(hit) >= n))
    assert set(packed) == set(clean)
