"""N-gram Jaccard join and near-duplicate groups with a prefix tree.

Documents become sets of 64-bit hashes of word n-grams.  Equal sets collapse to
one class, so copies cost one row each.

Candidates.  Two sets with Jaccard >= t share at least ``ceil(t * n)`` members, for
either n.  So the first ``n - ceil(t * n) + l`` hashes of each (in hash order) share
at least ``l``; of these short lists, in order of how many lists have a hash, the
first ``len - l + 1`` share at least one.  The lists travel once, as packed bytes by
bucket of hashes, and each bucket is sorted on its own: hashes that one list alone has
fall away there, and with them nearly all documents without a partner.  Lists that
share a rare hash and are near enough in size are joined into blocks, by connected
components over (document, smallest document of the bucket) edges.

Verification.  Only members of blocks are read again (a bitmap of fixed size picks
them out of the scan), and every set travels to its block once.  A block's sets are
put in one global order, rarest hash first, and stored in a prefix tree whose nodes
hold runs of hashes.  Each set walks the tree: the overlap with a run is
counted once for all sets below it; a subtree is left when the hashes remaining on
either side can't reach the least overlap, when sizes differ too much, or when all
of it already belongs to the set's own group.  So a group of k near copies costs
about k walks and k - 1 links instead of all pairs.

A block with more than ``block_members`` hashes is dealt twice into random parts
that are solved alone, which joins large groups; then only parts that still hold
different groups are compared, pair by pair, so no link is lost.

Cases: null and empty texts have no n-grams and stay alone; a text with fewer words
than ``width`` is one n-gram; rows that share a ``doc_id`` are one document with all
their links; rows with a null ``doc_id`` take part in no link of their own, and get
the group of their copies; very long texts are one set, however large, and a set
larger than ``block_members`` meets one other part at a time; ties in frequency are
broken by the hash, which no result depends on; columns besides id and text, whatever
their names, are not read by ``groups`` and are kept by ``one_of_each``; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .columns import bit_of, bits, is_set, split_by_bits, text_hash, without
from .components import components
from .scratch import Scratch

#: Hashes that one bucket of the count holds in the mean, at most.
_BUCKET = 1_000_000


def ngram_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(width):  # a 64-bit mix of the words in order
        out ^= h[k : k + n]
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _least(n: int, percent: int) -> int:
    """Members that a set of n shares at least with any partner."""
    return -(-percent * n // 100)


def list_length(n: int, percent: int) -> int:
    """Hashes of a set of n that are kept for the candidate search."""
    return min(n, n - _least(n, percent) + max(1, n // 10))


def prefix_length(n: int, percent: int) -> int:
    """How many of them, rarest first, must include one that a partner's have too."""
    return list_length(n, percent) - max(1, _least(n, percent) // 10) + 1 if n else 0


def _signatures(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, key, take, m, list): size and hash of the set, its list for the candidate search of m hashes, and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ns, keys, lists, take = [], [], [], []
            for value in batch.column(1):
                h = ngram_hashes(value.as_py(), width)
                n = len(h)
                ns.append(n)
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                lists.append(h[: list_length(n, percent)].view(np.int64))
                take.append(prefix_length(n, percent))
            if ns:
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(take, pa.int32()), pa.array(np.diff(ends), pa.int32()), made], ["doc_id", "n", "key", "take", "m", "list"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n long, key binary, take int, m int, list array<long>")


def _packed(lists: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ids, hs) from (doc_id, list): hashes and their documents, many to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            h = column.flatten().to_numpy()
            if not len(h):
                continue
            ids = np.repeat(batch.column(0).to_numpy(), column.value_lengths().to_numpy())
            bucket = ((h.view(np.uint64) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            h, ids, sizes = h[order], ids[order], np.bincount(bucket, minlength=buckets)
            ends = np.cumsum(sizes)
            filled = np.flatnonzero(sizes).tolist()
            spans = [(int(ends[b] - sizes[b]), int(ends[b])) for b in filled]
            # Steps from one document to the next are small numbers, nearly all of their bytes zero.
            steps = [np.ascontiguousarray(np.diff(ids[x:y], prepend=0).view(np.uint8).reshape(-1, 8).T).tobytes() for x, y in spans]
            made = [pa.array(filled, pa.int32()), pa.array([zstandard.compress(v, 1) for v in steps], pa.binary()), pa.array([h[x:y].tobytes() for x, y in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["bucket", "ids", "hs"])

    return lists.select("doc_id", "list").mapInArrow(run, "bucket int, ids binary, hs binary")


def _shared(packed: DataFrame, tasks: int) -> DataFrame:
    """(id, h, df) of the hashes that more than one list has; each bucket is sorted on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, hs = None, [], []

        def found() -> pa.RecordBatch:
            one = np.concatenate([np.cumsum(np.ascontiguousarray(np.frombuffer(zstandard.decompress(v), np.uint8).reshape(8, -1).T).view(np.int64).ravel()) for v in ids])
            h = np.concatenate([np.frombuffer(v, np.int64) for v in hs])
            order = np.argsort(h, kind="stable")
            h = h[order]
            starts = np.concatenate([[0], 1 + np.flatnonzero(h[1:] != h[:-1])])
            df = np.diff(np.append(starts, len(h)))
            df = np.repeat(df, df)
            several = df > 1
            return pa.RecordBatch.from_arrays([pa.array(one[order[several]]), pa.array(h[several]), pa.array(df[several].astype(np.int64))], ["id", "h", "df"])

        for batch in batches:
            for bucket, x, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != key:
                    if ids:
                        yield found()
                    key, ids, hs = bucket, [], []
                ids.append(x)
                hs.append(y)
        if ids:
            yield found()

    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "id long, h long, df long")


def _lists(wide: DataFrame, signed: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    """Packed lists of each class's first document.

    A map tells which documents may be copies; they alone are joined with the classes.
    """
    copies = signed.join(classes, "key").where(F.col("doc_id") != F.col("id"))
    rows = wide.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    found = bits(bit_of(F.col("doc_id")), copies)
    if not found.any():
        return _packed(rows, buckets)
    first, asked = split_by_bits(rows, bit_of(F.col("doc_id")), found)
    asked = asked.join(classes, (asked["key"] == classes["key"]) & (asked["doc_id"] == classes["id"]), "left_semi")
    return _packed(first, buckets).unionByName(_packed(asked, buckets))


def _candidates(shared: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join all documents which may have a link, and some more.

    Texts of one id have their hashes together, which leaves none of them out.
    """
    rare_first = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))  # one document's own hashes
    alive = rare_first.join(reps, "id")
    room = F.col("take") - (F.col("m") - F.size("x"))  # hashes that no other list has come first
    buckets = alive.where(room > 0).select("id", "n", F.explode(F.slice("x", 1, room)).alias("x")).select("id", "n", "x.h")
    # Sizes on a scale where partners are at most 1 apart; bands of 4, and the next one where a partner may be in it.
    place = F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100)) if percent < 100 else F.col("n").cast("double") * 2
    bands = F.array_distinct(F.array(F.floor(place / 4), F.floor((place + 1.0001) / 4)))
    banded = buckets.select("id", F.explode(bands).alias("band"), "h")
    heads = banded.groupBy("h", "band").agg(F.min("id").alias("b"), F.max("id").alias("top")).where(F.col("b") < F.col("top")).drop("top")
    return banded.join(heads, ["h", "band"]).select(F.col("id").alias("a"), "b").where(F.col("a") != F.col("b")).distinct()


def _sets(docs: DataFrame, wanted: np.ndarray, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, set) of the documents whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            kept = np.flatnonzero(is_set(mine, batch.column(2).to_numpy()))
            if len(kept):
                part = batch.take(pa.array(kept))
                hashes = [ngram_hashes(v.as_py(), width).view(np.int64) for v in part.column(1)]
                ends = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hashes)))], ["doc_id", "set"])

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), bit_of(F.col(id_col).cast("long")).alias("bit"))
    return source.mapInArrow(run, "doc_id long, set array<long>")


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of all ranges, one after the other."""
    sizes = ends - starts
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    steps = np.ones(total, np.int64)
    full = sizes > 0
    firsts, lens = starts[full], sizes[full]
    at = np.concatenate([[0], np.cumsum(lens)[:-1]])
    steps[at] = firsts - np.concatenate([[0], (firsts + lens - 1)[:-1]])
    steps[0] = firsts[0]
    return np.cumsum(steps)


class PrefixTree:
    """Sets of one block in a tree of shared prefixes, and the groups their links make.

    Members are ranked rarest first, so the prefixes that differ are the telling ones.
    Nodes are rows of arrays: the run of members on the way to them, their depth, the
    range of sets below, their children.  A set walks the tree level by level, all of
    a level's nodes at once.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, run: int = 256):
        self.percent = percent
        members, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(members), np.int32)
        rank[np.lexsort([members, counts])] = np.arange(len(members), dtype=np.int32)
        ends = np.cumsum([len(s) for s in sets])
        paths = [np.sort(p) for p in np.split(rank[where], ends[:-1])]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">i4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes = np.array([len(p) for p in self.paths], np.int64)
        self.inside = np.zeros(len(members), bool)
        self.group = np.arange(len(sets))  # by place in the tree's order
        self._build(run)

    def _build(self, run: int) -> None:
        """Nodes from the shared lengths of neighbouring paths; long runs are cut."""
        paths, at = self.paths, np.concatenate([[0], np.cumsum(self.sizes)])
        tree = [0, 0, len(paths), []]  # depth, first set, last set + 1, children
        stack = [tree]
        for i, path in enumerate(paths):
            shared = 0
            if i:
                n = min(len(path), len(paths[i - 1]))
                differ = path[:n] != paths[i - 1][:n]
                shared = int(differ.argmax()) if differ.any() else n
            last = None
            while stack[-1][0] > shared:
                last = stack.pop()
                last[2] = i
            if last is not None and stack[-1][0] < shared:  # a new branching above the last subtree
                stack[-1][3][-1] = middle = [shared, last[1], 0, [last]]
                stack.append(middle)
            if stack[-1][0] < len(path):
                leaf = [len(path), i, 0, []]
                stack[-1][3].append(leaf)
                stack.append(leaf)
        for node in stack:
            node[2] = len(paths)
        rows, kids = [], [[]]  # node 0 is the root
        todo = [(0, tree)]
        while todo:
            number, node = todo.pop()
            for child in node[3]:
                above, depth = number, node[0]
                while depth < child[0]:
                    to = min(child[0], depth + run)
                    rows.append((at[child[1]] + depth, at[child[1]] + to, to, child[1], child[2]))
                    kids.append([])
                    kids[above].append(len(rows))
                    above, depth = len(rows), to
                todo.append((above, child))
        self.first = np.concatenate([[0], np.cumsum([len(k) for k in kids])])
        self.kids = np.array([x for k in kids for x in k], np.int64)
        self.start, self.stop, self.depth, self.lo, self.hi = (np.array(c, np.int64) for c in zip((0, 0, 0, 0, len(paths)), *rows, strict=True))
        self.members = np.concatenate(paths)
        # Equal sizes below a node mean that exactly the sets of the node's depth end there.
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.small = np.array([self.sizes[a:b].min() for a, b in zip(self.lo, self.hi, strict=True)])
        self.large = np.array([self.sizes[a:b].max() for a, b in zip(self.lo, self.hi, strict=True)])
        assert ends[-1] == len(self.members)

    def _join(self, a: int, b: int) -> None:
        x, y = self.group[a], self.group[b]
        self.group[self.group == max(x, y)] = min(x, y)

    def link(self) -> None:
        """Join every set with the groups of all sets that it is similar to."""
        for i, path in enumerate(self.paths):
            if i + 1 == len(self.paths) or (self.group == self.group[0]).all():
                return
            self.inside[path] = True
            self._walk(i, path)
            self.inside[path] = False

    def _walk(self, i: int, path: np.ndarray) -> None:
        n, q = len(path), self.percent
        settled = self.group == self.group[i]
        settled[: i + 1] = True  # earlier sets have walked already
        known = np.concatenate([[0], np.cumsum(settled)])
        nodes, overlap = self.kids[self.first[0] : self.first[1]], np.zeros(self.first[1], np.int64)
        while len(nodes):
            lo, hi = self.lo[nodes], self.hi[nodes]
            small, large = self.small[nodes], self.large[nodes]
            open_ = (known[hi] - known[lo] < hi - lo) & (100 * large >= q * n) & (100 * n >= q * small)
            nodes, overlap, small, large = nodes[open_], overlap[open_], small[open_], large[open_]
            if not len(nodes):
                return
            start, stop = self.start[nodes], self.stop[nodes]
            seen = self.inside[self.members[_ranges(start, stop)]]
            overlap = overlap + np.add.reduceat(seen, np.concatenate([[0], np.cumsum(stop - start)[:-1]]), dtype=np.int64)
            mine = n - np.searchsorted(path, self.members[stop - 1], side="right")
            best = overlap + np.minimum(mine, large - self.depth[nodes])
            live = (100 + q) * best >= q * (n + np.maximum(small, -(-q * n // 100)))  # else what remains can't reach the least overlap
            nodes, overlap, small = nodes[live], overlap[live], small[live]
            done = small == self.depth[nodes]  # sets that end at the node come first below it
            for node, k in zip(nodes[done].tolist(), overlap[done].tolist(), strict=True):
                size = int(self.depth[node])
                if (100 + q) * k >= q * (n + size):
                    for j in range(int(self.lo[node]), int(self.hi[node])):
                        if self.sizes[j] != size:
                            break
                        if self.group[j] != self.group[i]:
                            self._join(i, j)
            below = self.first[nodes], self.first[nodes + 1]
            overlap = np.repeat(overlap, below[1] - below[0])
            nodes = self.kids[_ranges(*below)]


def _solve(parts: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Edges (a, b) from each set to the first of its group, within each part(block, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def solved() -> pa.RecordBatch | None:
            if len(ids) < 2:
                return None
            tree = PrefixTree(sets, percent)
            tree.link()
            heads = np.array(ids)[tree.order]
            first = heads[tree.group]
            return pa.RecordBatch.from_arrays([pa.array(heads), pa.array(first)], ["a", "b"])

        for batch in batches:
            for block, part, doc, values in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if (block, part) != key:
                    if (out := solved()) is not None:
                        yield out
                    key, ids, sets = (block, part), [], []
                ids.append(doc)
                sets.append(values.values.to_numpy())
        if (out := solved()) is not None:
            yield out

    dealt = parts.select("block", "part", "doc_id", "set").repartition(tasks, "block", "part").sortWithinPartitions("block", "part")
    return dealt.mapInArrow(run, "a long, b long").where(F.col("a") != F.col("b"))


def groups(
    docs: DataFrame,
    width: int = 3,
    percent: int = 90,
    block_members: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = scratch.save(_signatures(docs, width, percent, id_col, text_col))
    signed = scratch.save(wide.select("doc_id", "n", "key", "take", "m"))
    classes = scratch.save(signed.where(F.col("n") > 0).groupBy("key").agg(F.min("doc_id").alias("id")))
    reps = signed.where(F.col("n") > 0).join(classes, (signed["key"] == classes["key"]) & (signed["doc_id"] == classes["id"]), "left_semi")
    total = signed.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    packed = _lists(wide, signed, classes, max(4 * tasks, -(-total // _BUCKET)))
    edges = scratch.save(_candidates(_shared(packed, tasks), reps.select(F.col("doc_id").alias("id"), "n", "take", "m").distinct(), percent))
    del packed
    scratch.drop(wide)
    scratch.tidy()  # the lists are needed no more
    blocks = scratch.save(components(edges, scratch).withColumnRenamed("root", "block"))
    several = not signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("doc_id").isNotNull() & (F.col("k") > 1)).isEmpty()
    found = _sets(docs, bits(bit_of(F.col("id")), blocks), width, id_col, text_col)
    members = found.join(blocks, found["doc_id"] == blocks["id"]).select("block", "doc_id", "set")
    members = scratch.save(members.dropDuplicates(["doc_id", "set"]) if several else members)
    del found
    scratch.tidy()
    sized = members.groupBy("block").agg(F.sum(F.size("set")).alias("size"), F.count(F.lit(1)).alias("docs"))
    large = scratch.save(sized.where(F.col("size") > block_members))
    edges = _solve(members.join(large, "block", "left_anti").withColumn("part", F.lit(0)), percent, tasks)
    if large.isEmpty():
        links = scratch.save(edges)
    else:
        links = _large_blocks(scratch, members, large, scratch.save(edges), percent, block_members, tasks)
    del edges
    scratch.drop(members)
    scratch.tidy()
    roots = components(links, scratch) if not links.isEmpty() else spark.createDataFrame([], "id long, root long")
    joined = signed.select("doc_id", "n", "key").join(classes, "key", "left").join(roots, "id", "left")
    own = joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "id", "doc_id")).alias("component_id"))
    return _by_document(own, scratch) if several else own


def _by_document(own: DataFrame, scratch: Scratch) -> DataFrame:
    """Join the groups of rows that share a doc_id."""
    rows = scratch.save(own)
    edges = rows.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    roots = components(edges, scratch)
    return rows.join(roots, rows["component_id"] == roots["id"], "left").select("doc_id", "n_shingles", F.coalesce("root", "component_id").alias("component_id"))


def _large_blocks(scratch: Scratch, members: DataFrame, large: DataFrame, edges: DataFrame, percent: int, block_members: int, tasks: int) -> DataFrame:
    """Edges of all blocks, those too large for one task included."""
    rows = scratch.save(members.join(large, "block").withColumn("parts", F.ceil(F.col("size") * 2 / block_members)))
    dealt = [rows.withColumn("part", F.pmod(F.xxhash64(F.lit(salt), "doc_id"), "parts")) for salt in (1, 2)]
    edges = scratch.save(edges.unionByName(_solve(dealt[0], percent, tasks)).unionByName(_solve(dealt[1], percent, tasks)))
    if edges.isEmpty():
        known = rows.select("doc_id").distinct().select(F.col("doc_id").alias("id"), F.col("doc_id").alias("root"))
    else:
        known = components(edges, scratch)
    tagged = rows.join(known, rows["doc_id"] == known["id"], "left").withColumn("root", F.coalesce("root", "doc_id")).drop("id")
    open_blocks = tagged.groupBy("block").agg(F.min("root").alias("x"), F.max("root").alias("y")).where(F.col("x") < F.col("y")).select("block")
    # A group's rows get parts of their own where it fills some; small groups share parts by hash.
    weight = tagged.groupBy("block", "root").agg(F.sum(F.size("set")).alias("mass"))
    own = F.ceil(F.col("mass") * 2 / block_members)
    parted = tagged.join(weight, ["block", "root"]).withColumn(
        "part",
        F.when(F.col("mass") * 2 > block_members, F.xxhash64("root", F.pmod(F.xxhash64(F.lit(3), "doc_id"), own))).otherwise(
            F.pmod(F.xxhash64(F.lit(4), "root"), "parts")
        ),
    )
    parted = scratch.save(parted.join(open_blocks, "block", "left_semi").select("block", "part", "root", "doc_id", "set"))
    parts = parted.groupBy("block", "part").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    left, right = parts.select("block", F.col("part").alias("p"), F.col("x").alias("x1"), F.col("y").alias("y1")), parts.select("block", F.col("part").alias("q"), "x", "y")
    differ = ~((F.col("x1") == F.col("y1")) & (F.col("x") == F.col("y")) & (F.col("x") == F.col("x1")))
    pairs = scratch.save(left.join(right, "block").where((F.col("p") < F.col("q")) & differ).select("block", "p", "q", F.xxhash64("p", "q").alias("pair")))
    alone = parts.join(pairs.select("block", F.col("p").alias("part")).union(pairs.select("block", F.col("q").alias("part"))).distinct(), ["block", "part"], "left_anti")
    sides = pairs.select("block", "pair", F.explode(F.array("p", "q")).alias("part")).unionByName(alone.where(F.col("x") < F.col("y")).select("block", F.col("part").alias("pair"), "part"))
    compared = parted.join(sides, ["block", "part"]).select("block", F.col("pair").alias("part"), "doc_id", "set")
    return scratch.save(edges.unionByName(_solve(compared, percent, tasks)))


def one_of_each(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, with all their columns; one of the rows that repeat an id and its text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join-drop")
    if docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("k")).where((F.col("k") > 1) | F.col(id_col).isNull()).isEmpty():
        found = groups(docs, width, percent, id_col=id_col, text_col=text_col)
        gone = scratch.save(found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(id_col)).distinct())
        # A map tells which rows can be gone; they alone, and not all texts, may be shuffled for the join.
        places = bits(bit_of(F.col(id_col).cast("long")), gone)
        if not places.any():
            return docs
        stay, asked = split_by_bits(docs, bit_of(F.col(id_col).cast("long")), places)
        return stay.union(asked.join(gone, id_col, "left_anti").select(*docs.columns))
    # Ids don't tell the rows apart: each id and text gets a number, in the order of the ids, nulls last.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("h"))
    numbers = scratch.save(rows.select("id", "h").distinct().orderBy(F.asc_nulls_last("id"), "h").select("id", "h", F.monotonically_increasing_id().alias("row")))
    numbered = scratch.save(rows.join(numbers, rows["id"].eqNullSafe(numbers["id"]) & (rows["h"] == numbers["h"])).select("row", "text"))
    found = groups(numbered.dropDuplicates(["row"]), width, percent, id_col="row", text_col="text")
    gone = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("row"))
    left = without(docs, scratch.save(numbers.join(gone, "row").select("id", "h")), id_col, text_col)
    return left.withColumn("_h", text_hash(F.col(text_col))).dropDuplicates([id_col, "_h"]).select(*docs.columns)
