"""Operator 9, near-duplicate documents by BagMinHash over multisets of five-word shingles.

A shingle that occurs c times has weight c. Each shingle drives a hierarchy of Poisson processes, one for
each dyadic range [0,1), [1,2), [2,4), [4,8) ... of its discretised weight: points arrive with the range's
length as rate, each with a signature component and, by the bits of its hash, a place in the range. The points
placed under c count; a component keeps the earliest one. Two documents then agree in a component with the
probability of their weighted Jaccard similarity, and a document takes about m ln m points whatever its length.

Exact copies are one node. Nodes that share a band of six components are candidates; in each bucket all are
compared with a pivot (the node that has most company in all its buckets, as the origin of many edited copies
has), by exact multiset overlap. Where a bucket's nodes are not in one class after that, each node outside of
the pivot's class is held against all others of the bucket that aren't in its own class, but for those that can't
be similar: a node's shingles that no other open node has are lost for every overlap, which bounds its similarity
to any of them, and leaves out the far ends of large clouds of edited copies without comparing them.
Classes are the connected components of the verified links.

A text is worked through in pieces of words and shingles, so a very long one needs about 40 bytes a word and no more.

Results for odd input: words are lower-cased and split at ASCII white space; a text of one to four words is a
single shingle; null texts and texts without words are classes of their own; equal texts always share a class;
class_id is the least non-null doc_id of the class (null if there is none); repeated rows get equal rows; rows
of different texts with one doc_id are told apart by their text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm import keyed, names, scratch, tokens
from lontar.llm.components import components

SHINGLE = 5
ELEMENTS = 100_000
ROWS = 1024
BLOCKS = 32  # pairs of blocks in an Arrow batch
POINTS = 16_384
_GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class NearDup:
    """Least similarity, bands and their width, the nodes of a large bucket that are compared as one block, and whether the second step may pass over pairs by their sketches."""

    similarity: float = 0.8
    bands: int = 42
    width: int = 6
    block: int = 256
    sketch: bool = True

    @property
    def components(self) -> int:
        return self.bands * self.width

    @property
    def least_agreement(self) -> int:
        """Components that agree in a pair of this similarity but for a chance under 1e-6 (five standard deviations)."""
        p, m = self.similarity, self.components
        return max(0, int(m * p - 5 * (m * p * (1 - p)) ** 0.5))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, hash and count of every distinct shingle of every row, sorted by row and hash."""
    hashes, bounds = tokens.hashed_words(*tokens.utf8(column))
    if len(column) == 1 and len(hashes) > SHINGLE:  # as below, without arrays for the row
        h = tokens.runs(hashes, SHINGLE)
        del hashes
        h.sort()
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return np.zeros(len(new), np.int64), h[new], np.diff(np.append(new, len(h)))
    rows, counts = tokens.rows_of_words(bounds), np.diff(bounds)
    h, at = tokens.windows(hashes, rows, SHINGLE)
    found, where = [h], [rows[at]]
    for n in range(1, SHINGLE):
        short = counts[rows] == n if len(rows) else np.zeros(0, bool)
        if short.any():
            h, at = tokens.windows(hashes[short], rows[short], n)
            found.append(h)
            where.append(rows[short][at])
    h, row = np.concatenate(found), np.concatenate(where)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))) if len(h) else np.zeros(0, np.int64)
    return row[new], h[new], np.diff(np.append(new, len(h)))


def signatures(row: np.ndarray, h: np.ndarray, count: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """The id of each row's earliest point in each of m components, shape (n_rows, m); 0 for rows without shingles."""
    best = np.full(n_rows * m, np.inf)
    ids = np.zeros(n_rows * m, np.uint64)
    weight = np.bincount(row, weights=count, minlength=n_rows)
    with np.errstate(divide="ignore"):
        until = m * (np.log(m) + 3) / weight
    todo = weight > 0
    while todo.any():
        for at in range(0, len(h), ELEMENTS):
            part = np.flatnonzero(todo[row[at : at + ELEMENTS]]) + at
            _race(row[part], h[part], count[part], until, best, ids, m)
        todo &= np.isinf(best.reshape(n_rows, m)).any(1)
        until = until * 4  # a point's time and place don't depend on how far its process is followed
        again = todo.repeat(m)
        best[again], ids[again] = np.inf, 0
    return ids.reshape(n_rows, m)


def _race(row: np.ndarray, h: np.ndarray, count: np.ndarray, until: np.ndarray, best: np.ndarray, ids: np.ndarray, m: int) -> None:
    """Follow the processes of some shingles up to their rows' time limits; each round's points go into best and ids at once."""
    ranges = 1 + np.ceil(np.log2(count)).astype(np.int64)
    element = np.repeat(np.arange(len(h)), ranges)
    level = np.arange(len(element)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    rate = np.where(level == 0, 1.0, low)
    seed = tokens.mix(h[element] ^ tokens.mix(level.astype(np.uint64) + np.uint64(1)))
    owner, most = row[element], count[element].astype(np.float64)
    time, limit, k = np.zeros(len(seed)), until[owner], 0
    while len(seed):
        points = max(1, min(64, POINTS // len(seed)))  # of each process in this round
        step = np.arange(k + 1, k + points + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
        k += points
        r = tokens.mix(seed[:, None] + step) if points > 1 else tokens.mix(seed + step)[:, None]
        times = np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / -rate[:, None]
        times[:, 0] += time
        times = np.cumsum(times, axis=1) if points > 1 else times
        go = times <= limit[:, None]
        who, point, when = np.nonzero(go)[0], r[go], times[go]
        place = tokens.mix(point ^ np.uint64(_GOLDEN))
        slot = owner[who] * m + ((place >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        ahead = when < best[slot]
        if low.any():  # of a range above the first, not all places are under the count
            ahead &= low[who] + rate[who] * ((place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < most[who]
        slot, point, when = slot[ahead], point[ahead], when[ahead]
        np.minimum.at(best, slot, when)
        first = when == best[slot]
        ids[slot[first]] = point[first]
        go = go[:, -1]
        time = times[go, -1]
        seed, rate, low, most, owner, limit = (x[go] for x in (seed, rate, low, most, owner, limit))


def band_keys(ids: np.ndarray, bands: int, width: int) -> np.ndarray:
    parts = ids.reshape(len(ids), bands, width)
    key = np.broadcast_to(tokens.mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(width):
        key = tokens.mix(key * np.uint64(0xA0761D6478BD642F) + parts[:, :, k])
    return key


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id, the text's node id, the lower-cased text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), F.lower(text).alias("text"))


FEATURES = "doc_id long, node long, words boolean, bands array<long>, sketch binary"


def _features(docs: DataFrame, rules: NearDup) -> DataFrame:
    """Band keys and one byte of each component, for every document; the bands of texts without words are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch, most_rows=ROWS):
                row, h, count = shingles(part.column("text"))
                n = len(part)
                ids = signatures(row, h, count, n, rules.components)
                words = np.bincount(row, minlength=n) > 0
                keys = band_keys(ids[words], rules.bands, rules.width).astype(np.int64)
                offsets = np.concatenate(([0], np.cumsum(words) * rules.bands)).astype(np.int32)
                sketch = (ids & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("node"), pa.array(words), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))), pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["doc_id", "node", "words", "bands", "sketch"],
                )

    return _nodes(docs).mapInArrow(run, FEATURES)


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts."""
    n = len(a)
    (row_a, h_a, c_a), (row_b, h_b, c_b) = shingles(a), shingles(b)
    row, h, c = np.concatenate((row_a, row_b)), np.concatenate((h_a, h_b)), np.concatenate((c_a, c_b))
    order = np.lexsort((h, row))
    row, h, c = row[order], h[order], c[order]
    same = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]))
    both = np.bincount(row[same], weights=np.minimum(c[same], c[same + 1]), minlength=n)
    total = np.bincount(row, weights=c, minlength=n)
    return np.divide(both, total - both, out=np.zeros(n), where=total > both)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the nodes, once each; copies of a text go no further than the task that reads them."""
    some = keyed.among(_nodes(docs).filter("text is not null").select("node", "text"), "node", nodes, once=True)
    return some.dropDuplicates(["node"]).join(nodes, "node", "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, rules: NearDup) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the similarity."""
    texts = scratch.table(_texts(docs, scratch.checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())), "texts")
    least = rules.similarity - 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch, "text_b"):
                for half in tokens.chunks(part, "text_a"):
                    ok = pa.array(overlap(half.column("text_a"), half.column("text_b")) >= least)
                    yield half.select(["a", "b"]).filter(ok)

    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with scratch.batches(docs.sparkSession, ROWS):
        out = scratch.checkpoint(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))
    scratch.drop(texts)
    return out


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(docs: DataFrame, rules: NearDup = NearDup(), features: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Verified links between different texts' nodes, enough to connect every class, and (node, root) of the linked ones."""
    own = features is None
    features = scratch.table(_features(docs, rules), "signatures") if own else features
    reps = scratch.table(features.filter("words").dropDuplicates(["node"]).select("node", "bands", "sketch"), "bands")
    rows = reps.select("node", F.explode("bands").alias("key"))
    buckets = scratch.checkpoint(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = scratch.checkpoint(rows.join(buckets, "key"))
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    pivots = members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("p")).select("key", F.col("p.node").alias("pivot"))
    members = scratch.checkpoint(members.join(scratch.checkpoint(pivots), "key").select("key", "node", "pivot"))
    pairs = scratch.checkpoint(members.filter("node <> pivot").select(*_ordered("node", "pivot")).distinct())
    found = _verified(pairs, docs, rules)
    roots = scratch.checkpoint(components(found))
    with scratch.batches(docs.sparkSession, BLOCKS):
        rest = scratch.checkpoint(_open_pairs(members, roots, reps, docs, rules).join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        found = scratch.checkpoint(found.union(_verified(rest, docs, rules)))
        roots = scratch.checkpoint(components(found))
    scratch.drop(reps)
    if own:
        scratch.drop(features)
    return found, roots


def _open_pairs(members: DataFrame, roots: DataFrame, reps: DataFrame, docs: DataFrame, rules: NearDup) -> DataFrame:
    """In buckets of several classes: nodes outside of the pivot's class with nodes of other classes, if they may be similar."""
    of = lambda name, out: roots.select(F.col("node").alias(name), F.col("root").alias(out))
    placed = members.join(of("node", "root"), "node", "left").join(of("pivot", "main"), "pivot", "left")
    placed = scratch.checkpoint(placed.select("key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("main", "pivot").alias("main")))
    some = scratch.checkpoint(placed.join(placed.filter("root <> main").select("key").distinct(), "key", "left_semi"))
    weights = scratch.checkpoint(_shared_weights(scratch.checkpoint(some.select("node").distinct()), docs).filter(F.col("shared") >= F.col("weight") * (rules.similarity - 1e-9)))
    some = scratch.checkpoint(some.join(weights, "node"))
    some = some.join(reps.select("node", "sketch", "bands"), "node")
    sizes = some.groupBy("key").agg((F.count("*") / rules.block + 1).cast("int").alias("blocks"))
    dealt = scratch.checkpoint(some.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks"))))
    columns = ["node", "root", "weight", "shared", "sketch", "bands"]

    def packed(rows: DataFrame, side: str, other: str) -> DataFrame:
        """A row for each block and each block of the other side that it meets, so that every pair of blocks is a key of its own."""
        listed = rows.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct(*columns)).alias("l"))
        met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        return listed.select("key", F.col("block").cast("int").alias(f"block_{side}"), met.alias(f"block_{other}"), *[F.expr(f"transform(l, x -> x.{c})").alias(f"{c}_{side}") for c in columns])

    return _alike(packed(dealt.filter("root <> main"), "a", "b").join(packed(dealt, "b", "a"), ["key", "block_a", "block_b"]), rules)


def _alike(blocks: DataFrame, rules: NearDup) -> DataFrame:
    """Of a block of nodes and another of the same bucket: the pairs of different classes that may be similar.

    Only these leave the task, each from the first band that its nodes have in common. They must share enough weight and,
    unless rules.sketch is off, agree in enough components; a block has about rules.block nodes and each pair of blocks
    is a task's row, so a bucket of any size is dealt over many tasks.
    """

    def column(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
        return batch.column(name)[i].values.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                a, b = ({c: column(batch, f"{c}_{side}", i) for c in ("node", "root", "weight", "shared")} for side in "ab")
                x, y = (np.frombuffer(b"".join(batch.column(f"sketch_{side}")[i].as_py()), np.uint8).reshape(-1, rules.components) for side in "ab")
                own, other = (batch.column(f"bands_{side}")[i].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, rules.bands) for side in "ab")
                key = batch.column("key")[i].as_py()
                for k in range(len(x)):
                    most = np.minimum(a["shared"][k], b["shared"])
                    ok = np.flatnonzero((a["root"][k] != b["root"]) & (most >= (a["weight"][k] + b["weight"] - most) * (rules.similarity - 1e-9)))
                    ok = ok[(y[ok] == x[k]).sum(1) >= rules.least_agreement] if rules.sketch else ok
                    ok = ok[own[k][(other[ok] == own[k]).argmax(1)] == key]
                    if len(ok):
                        here, there = np.full(len(ok), a["node"][k]), b["node"][ok]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(here, there)), pa.array(np.maximum(here, there))], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def _shared_weights(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, weight (all its shingles) and shared (those that another of the nodes has too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch):
                row, h, count = shingles(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(count)], names=["node", "h", "n"])

    each = scratch.table(_texts(docs, nodes).mapInArrow(run, "node long, h long, n long"), "shingles")
    lone = each.groupBy("h").agg(F.count("*").alias("nodes"), F.min("node").alias("node"), F.min("n").alias("n")).filter("nodes = 1").groupBy("node").agg(F.sum("n").alias("lone"))
    total = each.groupBy("node").agg(F.sum("n").alias("weight"))
    out = scratch.checkpoint(total.join(lone, "node", "left").select("node", "weight", (F.col("weight") - F.coalesce("lone", F.lit(0))).alias("shared")))
    scratch.drop(each)
    return out


def classes(docs: DataFrame, rules: NearDup = NearDup()) -> DataFrame:
    """doc_id, node, class_id and class_size of every document."""
    with scratch.batches(docs.sparkSession, 2 * ROWS):
        features = scratch.table(_features(docs, rules), "signatures")
    _, roots = links(docs, rules, features)
    ids = scratch.checkpoint(features.select("doc_id", "node", "words"))
    scratch.drop(features)
    by_node = ids.filter("words").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    rooted = scratch.checkpoint(by_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    by_root = scratch.checkpoint(rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size")))
    by_node = rooted.join(by_root, "root").select("node", "class_id", "class_size")
    out = ids.join(scratch.checkpoint(by_node), "node", "left")
    return out.select("doc_id", "node", F.when(F.col("words"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("words"), F.col("class_size")).otherwise(F.lit(1)).cast("long").alias("class_size"))


def drop_near_duplicates(docs: DataFrame, rules: NearDup = NearDup()) -> DataFrame:
    """docs without all but one document of each class: the one with the least doc_id (one of its repeated rows) stays."""
    found = scratch.checkpoint(classes(docs, rules))
    first, keys = F.col("doc_id").eqNullSafe(F.col("class_id")), ["node", "doc_id"]
    drop = found.filter(~first).select(*keys).distinct()
    repeated = found.filter(first & (F.col("class_size") > 1)).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    gone = scratch.checkpoint(drop.union(repeated))
    staged = names.plain(docs, node=F.xxhash64(F.col("text").cast("string")), doc_id=F.col("doc_id").cast("long"))
    left = keyed.without(staged, "node", gone, keys)
    if not repeated.isEmpty():
        back = scratch.checkpoint(repeated).alias("back")
        same = staged["node"].eqNullSafe(back["node"]) & staged["doc_id"].eqNullSafe(back["doc_id"])
        left = left.unionByName(staged.join(back, same, "left_semi").dropDuplicates(keys))
    return names.restored(left, docs)
