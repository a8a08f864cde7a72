"""Near-duplicate documents by chosen-path set similarity join.

A document is its set of word shingles. Equal sets are one class from the start, found by a 128-bit digest and
numbered; all that follows, up to the last step, is about classes, and copies are never expanded. Each class has a row
of minhash values, one for each of COORDINATES hash functions. In each of a number of independent
trees a node branches on one coordinate, which a hash of the node's path selects: members with the same value at
that coordinate go to the same child. Nodes of at most SMALL members are compared exhaustively; larger nodes link
their members to the node's pivot and branch again, down to the last depth. Two sets of similarity s meet in a node at
depth d with probability s^d. The last depth is the greatest at which all trees miss a pair at the threshold with
probability MISS or less: 3 for .85 and 12 trees (1.1e-5), 2 for .8 (4.7e-6). Nodes still large there are compared
exhaustively too, in salted blocks of members, whatever their size; the recall of the last depth holds for all pairs.

A pair whose minhash values agree far less often than the threshold asks (by SLACK, over five standard deviations:
a chance below 1e-7) is no candidate. Every candidate is confirmed by the exact intersection and union of both full
sets. Pairs within a group of
copies are never all emitted: first pivots link what they can, connected components are formed from the confirmed
links, and then only pairs of different components are compared. Components come from alternating large-star and
small-star steps, each one or two shuffles of the link table; no link or component goes to the driver.

Defined results: white space is ASCII's; A to Z are lower-cased; a text of fewer words than a shingle has is one
shingle, whole; null texts and texts without words have an empty set and link with nothing. Rows with equal ids are
one document, whose different texts all link: their classes are one component. A null id is linked with nothing:
component_id null, kept true. Very long texts are hashed whole, some shingles at a time. An empty table gives an empty
table. Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, cut, discard, free_name

COORDINATES, SMALL, TREES, DEPTH = 64, 24, 12, 10
#: A pair at the threshold may be missed by all trees with this probability.
MISS = 1e-4
#: Members of a large node in one block; a task compares two blocks.
BLOCK = 512
#: A candidate's share of equal minhash values may be so much below the threshold.
SLACK = 0.28
#: Trees whose first nodes' pivots give the first links: the pivot of a group of copies is the same in most of them.
FIRST_TREES = 4
#: Bytes of a shingle's hash in a stored set: two sets of 10^4 shingles share a false one with probability below 10^-6.
WIDTH = 6
#: Hashes of documents that a filter of texts tells apart.
SLOTS = 1 << 18
_M = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(cache) > 300_000:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(min(k, len(h))), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(h))):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, _M, COORDINATES, np.uint64), rng.integers(0, _M, COORDINATES, np.uint64) | np.uint64(1)


def minhashes(s: np.ndarray, add: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of each function."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            part = (s[at : at + 4096, None] ^ add) * times
            least = np.minimum(least, (part >> np.uint64(32)).min(0))
    return least.astype(np.uint32).view(np.int32)


def digest(s: np.ndarray) -> np.ndarray:
    """128 bits of a set, as two numbers."""
    return np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)


def pack(s: np.ndarray) -> bytes:
    """The lowest WIDTH bytes of each hash."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.reshape(-1).view("<u8")


def sign(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, d1, d2 (digest of the set), sig (minhash values; empty for an empty set), sketch (their lowest bytes)."""
    schema = "id long, n long, d1 long, d2 long, sig array<int>, sketch binary"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        add, times = _hashes()
        for batch in batches:
            n, digests, sigs, ends, low = [], [], [], [0], []
            for text in batch.column(1):
                s = shingles(text.as_py(), k, cache)
                n.append(len(s))
                digests.append(digest(s))
                if len(s):
                    sigs.append(minhashes(s, add, times))
                low.append((sigs[-1] & 0xFF).astype(np.uint8).tobytes() if len(s) else b"")
                ends.append(len(sigs) * COORDINATES)
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int32)
            d = np.array(digests).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)).cast(fields[4].type), pa.array(low, pa.binary())], schema=fields)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def _branch(path):
    """The path of a member's child: the selected coordinate's value goes into it."""
    at = F.pmod(F.xxhash64(F.lit(7), path), F.lit(COORDINATES)).cast("int")
    return F.xxhash64(path, F.get("sig", at))


def nodes(sets: DataFrame, trees: int, last: int) -> DataFrame:
    """tree, path, id, size, pivot, depth of all nodes with two members or more, down to depth last. sets: id, sig, one row for each class."""
    rank = F.xxhash64(F.lit(3), "id")
    members = sets.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    members = members.select("tree", _branch(F.xxhash64(F.lit(5), "tree")).alias("path"), "id")
    found = []
    for depth in range(1, last + 1):
        kinds = members.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(rank, "id")).alias("least")).where("size > 1")
        level = cut(members.join(kinds.select("tree", "path", "size", F.col("least")["id"].alias("pivot")), ["tree", "path"]).withColumn("depth", F.lit(depth)), f"paths{depth}")
        found.append(level)
        large = level.where(F.col("size") > SMALL)
        if depth == last or large.isEmpty():
            break
        members = large.select("tree", "path", "id").join(sets, "id").select("tree", _branch(F.col("path")).alias("path"), "id")
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def _similar(percent: int):
    fields = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, mine = a, unpack(x.as_py())
                other = unpack(y.as_py())
                small, big = sorted((len(mine), len(other)))
                both = len(np.intersect1d(mine, other, assume_unique=True)) if 100 * small >= percent * big else 0
                keep.append(100 * both >= percent * (small + big - both))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], schema=fields)

    return run


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose minhash values agree often enough for the full sets to be looked at."""
    fields = arrow_schema("a long, b long")
    least = COORDINATES * (percent / 100 - SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (2, 3))
            keep = pa.array((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=fields)

    left, right = (sets.select(F.col("id").alias(n), F.col("sketch").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the documents wanted. Most others are dropped before the shuffle: those whose hash has no slot; there are SLOTS at most to broadcast."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(SLOTS))
    slots = wanted.select(slot.alias("slot")).distinct()
    return texts.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot").join(wanted, "doc", "left_semi")


def _packed(involved: DataFrame, sets: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, packed (the full set) of the classes involved: from the texts of their least documents whose digest is the class's."""
    schema = "doc long, d1 long, d2 long, packed binary"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            found = [shingles(t.as_py(), k, cache) for t in batch.column(1)]
            d = np.array([digest(s) for s in found], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(map(pack, found), pa.binary())], schema=fields)

    want = cut(sets.join(involved, "id", "left_semi").select("id", "rep", "d1", "d2"), "wanted")
    texts = _of(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), want.select(F.col("rep").alias("doc")).distinct())
    both = texts.mapInArrow(run, schema).join(want, ["d1", "d2"]).where("doc = rep")
    return cut(both.dropDuplicates(["d1", "d2"]).select("id", "packed"), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    involved = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    packed = _packed(involved, sets, docs, k, id_col, text_col)
    left = packed.select(F.col("id").alias("a"), F.col("packed").alias("x"))
    right = packed.select(F.col("id").alias("b"), F.col("packed").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    links = cut(both.mapInArrow(_similar(percent), "a long, b long"), "links")
    discard(packed)
    return links


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right, by products of 0-1 matrices."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(shared):
        return out
    sides = []
    for sets in (left, right):
        values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        order = np.argsort(at[hit], kind="stable")
        sides.append((row[hit][order], at[hit][order], len(sets)))
    step = 4096
    for start in range(0, len(shared), step):
        parts = []
        for row, at, n in sides:
            i, j = np.searchsorted(at, (start, start + step))
            m = np.zeros((n, min(step, len(shared) - start)), np.float32)
            m[row[i:j], at[i:j] - start] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _forest(percent: int):
    """For two blocks of a node: links between their components, as many as it takes to join what is similar enough."""
    fields = arrow_schema("a long, b long")

    def run(table: pa.Table) -> pa.Table:
        ids, own, at = (table.column(c).to_numpy() for c in ("id", "own", "at"))
        sets = [unpack(p.as_py()) for p in table.column("packed")]
        first, second = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        i, j = np.flatnonzero(at == first), np.flatnonzero(at == second)
        found: list[tuple[int, int]] = []
        if len(i) and len(j):
            n = np.array([len(s) for s in sets])
            both = intersections([sets[x] for x in i], [sets[y] for y in j])
            links = (100 * both >= percent * (n[i][:, None] + n[j] - both)) & (own[i][:, None] != own[j])
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    root[x] = root.get(up, up)
                    x = up
                return x

            for x, y in zip(*np.nonzero(links)):
                p, q = find(int(own[i[x]])), find(int(own[j[y]]))
                if p != q:
                    root[p] = q
                    found.append((int(ids[i[x]]), int(ids[j[y]])))
        a, b = zip(*found) if found else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=fields)

    return run


def settle(deep: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that join all components with similar members in a node. deep: tree, path, id, own (component).

    Each pair of members of different components is compared, by full sets. The largest component's members meet all
    others but not one another, so rows grow with the node's size times the blocks of the others.
    """
    sizes = deep.groupBy("tree", "path", "own").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("tree", "path").agg(F.max(F.struct("c", "own")).alias("main"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("several")).where("several > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    sizes = sizes.select("tree", "path", F.col("main.own").alias("most"), blocks(F.col("n") - F.col("main.c")).alias("few"), blocks(F.col("main.c")).alias("many"))
    members = deep.select("tree", "path", "id", "own").join(sizes, ["tree", "path"])
    other = F.col("own") != F.col("most")
    salt = F.xxhash64(F.lit(9), "id")
    members = members.withColumn("at", F.when(other, F.pmod(salt, F.col("few"))).otherwise(F.col("few") + F.pmod(salt, F.col("many"))))
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.when(other, F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1))))
    members = cut(members.select("tree", "path", "id", "own", "at", F.least("at", "with").alias("x"), F.greatest("at", "with").alias("y")), "blocks")
    packed = _packed(members.select("id").distinct(), sets, docs, k, id_col, text_col)
    links = cut(members.join(packed, "id").groupBy("tree", "path", "x", "y").applyInArrow(_forest(percent), "a long, b long"), "links")
    discard(packed)
    return links


def _is_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: each component is its least id with all others linked to it."""
    several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return several.isEmpty() and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """id, label (least id reachable) of every id that a link names. links: a, b in any direction."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct()
        edges = cut(small, "small-star")
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("id"), "label").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def _labelled(rows: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    named = labels.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
    return rows.join(named, F.col(column) == F.col("_i"), "left").withColumn(out, F.coalesce("_l", column)).drop("_i", "_l")


def _ordered(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def classes(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (least id reachable), kept (it is its own component's)."""
    signed = cut(sign(docs, k, id_col, text_col), "signed")
    some = F.col("id").isNotNull() & (F.col("n") > 0)
    # a class has its number once it is written; equal sets have equal minhash values, whichever row gives them
    sets = signed.where(some).groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    sets = cut(sets.withColumn("id", F.monotonically_increasing_id()), "classes")
    member = signed.where(some).select(F.col("id").alias("doc"), "n", "d1", "d2").join(sets.select("id", "rep", "d1", "d2"), ["d1", "d2"])
    member = cut(member.select("doc", "n", "id", "rep"), "members")
    # a document with several sets joins their classes
    several = member.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z")
    joined = cut(member.join(several, "doc").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "joined")
    last = last_depth(percent / 100, trees)
    found = cut(nodes(sets, trees, last), "nodes")

    first = cut(plausible(_ordered(found.where((F.col("tree") < FIRST_TREES) & (F.col("depth") == 1)), "id", "pivot"), sets, percent), "pairs")
    links = confirm(first, sets, docs, k, percent, id_col, text_col)
    labels = cut(components(links), "labels")

    rest = cut(_labelled(_labelled(found, labels, "id", "own"), labels, "pivot", "theirs"), "labelled")
    deep = (F.col("depth") == last) & (F.col("size") > SMALL)
    stars = _ordered(rest.where(F.col("own") != F.col("theirs")).where(~deep), "id", "pivot")
    mixed = rest.where(F.col("size") <= SMALL).groupBy("tree", "path").agg(F.collect_list(F.struct("own", "id")).alias("all"), F.min("own").alias("p"), F.max("own").alias("q")).where("p <> q")
    x = F.explode("all").alias("x")
    small = mixed.select("all", x).select(F.col("x"), F.explode("all").alias("y")).where("x.own < y.own").select(F.col("x.id").alias("i"), F.col("y.id").alias("j"))
    second = stars.unionByName(_ordered(small, "i", "j")).distinct().join(first, ["a", "b"], "left_anti")
    more = confirm(cut(plausible(second, sets, percent), "pairs"), sets, docs, k, percent, id_col, text_col)
    # nodes that stay large to the last depth
    more = more.unionByName(settle(rest.where(deep), sets, docs, k, percent, id_col, text_col))

    # from classes to documents: a component's least document, or the class's own where it is linked with none
    final = cut(components(links.unionByName(more).unionByName(joined)), "components")
    least = final.join(sets.select("id", "rep"), "id").groupBy("label").agg(F.min("rep").alias("least"))
    linked = final.join(least, "label").select("id", "least")
    with_words = member.join(linked, "id", "left").select("doc", "n", F.coalesce("least", "rep").alias("component_id"))
    # a row without words is its document's: linked as its other rows are, if it has any
    bare = signed.where(~some).select(F.col("id").alias("doc"), "n")
    theirs = with_words.join(bare.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.min("component_id").alias("component_id"))
    out = with_words.unionByName(bare.join(theirs, "doc", "left").select("doc", "n", F.coalesce("component_id", "doc").alias("component_id")))
    kept = F.col("doc").isNull() | (F.col("doc") == F.col("component_id"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def recall(similarity: float, depth: int, trees: int) -> float:
    """Probability that a pair meets in some tree's node at the depth."""
    return 1 - math.pow(1 - similarity**depth, trees)


def last_depth(similarity: float, trees: int) -> int:
    """The greatest depth at which a pair of the similarity is missed by all trees with probability MISS or less; from 1 to DEPTH."""
    depth = 1
    while depth < DEPTH and 1 - recall(similarity, depth + 1, trees) <= MISS:
        depth += 1
    return depth


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less all but one document of each component: the one with the least id, in one row (its longest text, ties by hash)."""
    keep, turn = free_name(docs.columns, "_kept"), free_name(docs.columns, "_turn")
    kept = classes(docs, k, percent, id_col=id_col, text_col=text_col).where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias(keep)).distinct()
    named = docs.join(kept, F.col(id_col).cast("long") == F.col(keep), "left_semi")
    first = Window.partitionBy(id_col).orderBy(F.desc_nulls_last(F.length(text_col)), F.xxhash64(text_col))
    named = named.withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).drop(turn)
    return named.unionByName(docs.where(F.col(id_col).isNull()))
