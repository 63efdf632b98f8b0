"""Operator 2, language-model scoring with a log-frequency Bloom filter.

Uni- and bigram counts are gathered from the whole training fold. A bigram's count is quantised to a level on a
logarithmic scale and kept as that many entries (bigram, 1), (bigram, 2), ... of one Bloom filter in slices of the hash; a
reader probes one level after the other until one is missing, and takes the mean count of the level found, as the
training fold has it. A slice grows with its entries, and every bigram is in it, at any size. While the filter keeps to a
fixed size it is broadcast; beyond that the bigrams of each chunk of documents meet the slices in a co-grouped join, and
their levels come back to the chunk. The results are the same.

Probabilities interpolate the bigram's relative frequency with the unigram's, smoothed by one; the bigram's weight is the
leave-one-out chance, over the training fold, that a bigram has been seen elsewhere, and goes to the unigram after a
context that hasn't been seen. Unigram counts are exact, as the baseline needs them anyway, so the unigrams' probabilities
and that of all unseen tokens together add up to one; the bigrams' do so but for the quantisation within a context (level
means keep the sum of all counts).

The most frequent tokens (a fixed number) are broadcast with their counts; a chunk asks for those of its other tokens by
the same join. Counts travel as packed arrays by slice, added up in each task before the shuffle, so no token, however
frequent, weighs on one task. Tokens are told apart by 64-bit hashes, pairs by a slice and 32 bits more, a chance of
error far below the filter's own.

Results for odd input: a null or empty text is its end token alone; without training documents the counts, N and V are
0 and base_score is 0.0 or a sum of log10(1 / 1); a null doc_id counts as an empty one for the fold; repeated rows get
equal rows and count as often in training; a very long text is a chunk of its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm import scratch, tokens
from lontar.llm.language import fold

END = np.uint64(0x2545F4914F6CDD1D)
CHUNK_BYTES = 4_000_000
CHUNK_ROWS = 8192
BATCH_BYTES = 3_000_000  # of an Arrow batch, which by default holds 10,000 rows, also of some MB each
GROUP_BYTES = 4_000_000  # of a row group of the scratch tables whose rows are chunks or slices
_BUFFER = 1_500_000
_PAIR = np.uint64(0xA0761D6478BD642F)
#: Steps of the scale in which a count doubles.
STEPS = 2
_SCALE = np.unique(np.ceil(2.0 ** (np.arange(63 * STEPS) / STEPS) - 1e-9)).astype(np.int64)
PAIR_BITS = 32  # of a pair's identity beyond its slice's


@dataclass(frozen=True)
class Rules:
    """Folds and the held-out one, the bits (log2) of a filter that is broadcast and the least of any, hashes and bits an entry at least, tokens broadcast with exact counts, documents a slice, and the least and most slices."""

    folds: int = 7
    held_out: int = 2
    filter_bits: int = 27
    hashes: int = 3
    bits_an_entry: int = 10
    head: int = 1 << 20
    slice_docs: int = 4000
    slices: tuple[int, int] = (16, 1 << 20)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, bounds = tokens.hashed_words(data, offsets, lower=True)
    return np.insert(words, bounds[1:], END), np.repeat(np.arange(len(offsets) - 1), np.diff(bounds) + 1)


def text_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token: the words of each row in lower case, then its end."""
    return _tokens(*tokens.utf8(column))


def bigrams(h: np.ndarray, bits: int) -> np.ndarray:
    """The hash of every token and the one before it (the end before a row's first word), cut after the PAIR_BITS that follow the slice's."""
    context = np.empty_like(h)
    context[:1] = END
    context[1:] = h[:-1]  # what stands before a row's first token is the end of the row before
    cut = np.uint64(64 - PAIR_BITS - bits)
    return tokens.mix(context * _PAIR + h) >> cut << cut


def _narrow(pairs: np.ndarray, bits: int) -> bytes:
    """Four bytes for each pair of one slice."""
    return (pairs << np.uint64(bits) >> np.uint64(64 - PAIR_BITS)).astype("<u4").tobytes()


def _widened(raw: bytes, bits: int, part: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.uint64) << np.uint64(64 - PAIR_BITS - bits) | np.uint64(part << (64 - bits) if bits else 0)


def _added(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and their summed counts."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(n, at) if len(at) else n


def _cuts(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each slice's part of sorted hashes begins (and ends)."""
    return np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(h)] if bits else [0, len(h)]


def _count_packs(texts: DataFrame, bits: int) -> DataFrame:
    """(slice, kind, once, more, counts): the n-grams of one slice that a task saw once, and the others with their counts."""
    raw = (lambda part: part.tobytes(), lambda part: _narrow(part, bits))

    def packs(kind: int, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        cuts = _cuts(h, bits)
        rows = []
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            part, count = h[cuts[s] : cuts[s + 1]], n[cuts[s] : cuts[s + 1]]
            rows.append((s, kind, raw[kind](part[count == 1]), raw[kind](part[count > 1]), count[count > 1].astype("<u4").tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["slice", "kind", "once", "more", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[], []]
        sizes = [0, 0]

        def flush(kind: int, least: int) -> Iterator[pa.RecordBatch]:
            if sizes[kind] > least:
                h, n = _added(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))
                held[kind], sizes[kind] = [(h, n)], len(h)
                if len(h) > least // 2:
                    yield packs(kind, h, n)
                    held[kind], sizes[kind] = [], 0

        for batch in batches:
            for part in tokens.chunks(batch, limit=CHUNK_BYTES, most_rows=CHUNK_ROWS):
                h, _ = text_tokens(part.column("text"))
                for kind, x in enumerate((h, bigrams(h, bits))):
                    held[kind].append(_added(x, np.ones(len(x), np.int64)))
                    sizes[kind] += len(held[kind][-1][0])
                    yield from flush(kind, _BUFFER)
        for kind in (0, 1):
            yield from flush(kind, 0)

    return texts.mapInArrow(run, "slice int, kind int, once binary, more binary, counts binary")


def _unpacked(table: pa.Table, kind: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    rows = [r for r in table.to_pylist() if r["kind"] == kind]
    once, more, counts = (b"".join(r[k] for r in rows) for k in ("once", "more", "counts"))
    part = rows[0]["slice"] if rows else 0
    once, more = (_widened(x, bits, part) if kind else np.frombuffer(x, np.uint64) for x in (once, more))
    return _added(np.concatenate((once, more)), np.concatenate((np.ones(len(once), np.int64), np.frombuffer(counts, "<u4").astype(np.int64))))


def levels(n: np.ndarray) -> np.ndarray:
    """The level of each count: 1 for 1, then one more at each step of the scale."""
    return np.searchsorted(_SCALE, n, "right")


@dataclass
class LogFilter:
    """A Bloom filter of (hash, level) in slices of the hash, as 64-bit words."""

    words: np.ndarray
    slice_bits: int
    hashes: int

    def _starts(self, h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bit of each hash's slice, and the start and step of its places there."""
        block = np.uint64(len(self.words) * 64 >> self.slice_bits)
        base = (h >> np.uint64(64 - self.slice_bits)) * block if self.slice_bits else np.zeros(len(h), np.uint64)
        x = tokens.mix(h ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        return base, x, (x >> np.uint64(32)) | np.uint64(1)

    def _place(self, base: np.ndarray, x: np.ndarray, step: np.ndarray, k: int) -> np.ndarray:
        return base + (x + np.uint64(k) * step) % np.uint64(len(self.words) * 64 >> self.slice_bits)

    def level(self, h: np.ndarray) -> np.ndarray:
        """The last level found by repeated probes, 0 for none."""
        out = np.zeros(len(h), np.uint8)
        alive, level = np.arange(len(h)), 0
        while len(alive) and level < 255:
            level += 1
            state = (alive, *self._starts(h[alive], level))
            for k in range(self.hashes):
                p = self._place(*state[1:], k)
                found = (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                state = tuple(x[found] for x in state)
            alive = state[0]
            out[alive] = level
        return out

    def add(self, h: np.ndarray, level: np.ndarray) -> None:
        for least in range(1, int(level.max(initial=0)) + 1):
            starts = self._starts(h[level >= least], least)
            for k in range(self.hashes):
                p = self._place(*starts, k)
                np.bitwise_or.at(self.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))


@dataclass
class Model:
    """The filter (None if it is too large to broadcast), the mean count of each level, the most frequent tokens with exact counts, the totals, the bigrams' weight, the table of exact counts and filter by slice, and how many entries the filter holds."""

    log_filter: LogFilter | None
    means: np.ndarray
    head: np.ndarray
    head_counts: np.ndarray
    total: int
    distinct: int
    bigram_weight: float
    counts: DataFrame
    slice_bits: int
    kept: int

    def logs(self, count: np.ndarray, level: np.ndarray, end: int) -> np.ndarray:
        """log10 of every token's probability from its count, its bigram's level, and the end token's count."""
        before = np.empty(len(count))
        before[1:] = count[:-1]
        before[:1] = end
        single = (count + 1) / (self.total + self.distinct + 1)
        weight = np.where(before > 0, self.bigram_weight, 0.0)
        return np.log10(weight * np.minimum(self.means[level], before) / np.maximum(before, 1) + (1 - weight) * single)


def train(docs: DataFrame, rules: Rules = Rules()) -> Model:
    """Count all training documents' tokens and bigrams, and fill the filter."""
    n_docs = docs.count()
    low, high = rules.slices
    bits = min(max(low, -(-n_docs // rules.slice_docs)), high).bit_length()
    block = 1 << max(6, rules.filter_bits - bits)
    head = max(1, rules.head >> bits)
    training = docs.filter(fold(F.col("doc_id"), rules.folds) != rules.held_out).select(F.col("text").cast("string").alias("text"))
    packs = _count_packs(training, bits)
    kinds = {"slice": pa.int32(), "bits": pa.binary(), "head": pa.binary(), "head_counts": pa.binary(), "hashes": pa.binary(), "counts": pa.binary(), "total": pa.int64(), "distinct": pa.int64(), "again": pa.int64(), "kept": pa.int64(), "sums": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64())}

    def reduced(table: pa.Table) -> pa.Table:
        (uni, n_uni), (pairs, n_pairs) = (_unpacked(table, kind, bits) for kind in (0, 1))
        level = levels(n_pairs)
        kept = int(level.sum())
        small = LogFilter(np.zeros(max(block, kept * rules.bits_an_entry + 63) // 64, np.uint64), 0, rules.hashes)
        small.add(pairs, level)
        top = np.sort(np.argsort(-n_uni, kind="stable")[:head])
        sums, sizes = (np.bincount(level, n_pairs if add else None, 256).astype(np.int64).tolist() for add in (True, False))
        row = [table.column("slice")[0].as_py(), small.words.tobytes(), uni[top].tobytes(), n_uni[top].tobytes(), uni.tobytes(), n_uni.tobytes(), int(n_uni.sum()), len(uni), int((n_pairs - 1).sum()), kept, sums, sizes]
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds.values(), strict=True)], names=list(kinds))

    schema = "slice int, bits binary, head binary, head_counts binary, hashes binary, counts binary, total long, distinct long, again long, kept long, sums array<long>, sizes array<long>"
    with scratch.batch_bytes(docs.sparkSession, BATCH_BYTES):
        counts = scratch.table(packs.groupBy("slice").applyInArrow(reduced, schema), "counts", GROUP_BYTES)
    totals = counts.agg(F.sum("total"), F.sum("distinct"), F.sum("again"), F.sum("kept"), F.max(F.length("bits"))).first()
    total, distinct, again, kept, largest = (x or 0 for x in totals)
    means = np.concatenate(([0.0], _SCALE, np.full(256, float(_SCALE[-1]))))[:256]  # the least count of a level that no bigram has; a false positive may lead there
    for row in counts.select(F.posexplode(F.arrays_zip("sums", "sizes")).alias("level", "x")).groupBy("level").agg(F.sum("x.sums").alias("s"), F.sum("x.sizes").alias("n")).filter("n > 0 and level > 0").collect():  # 255 rows at most
        means[row["level"]] = row["s"] / row["n"]
    small = largest * 8 <= block  # then the whole filter is of 2**filter_bits bits
    words = np.zeros((1 << bits) * block // 64 if small else 0, np.uint64)
    heads, head_counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for row in counts.select("slice", "head", "head_counts", *(["bits"] if small else [])).toLocalIterator():  # the filter's size and the head's in all
        if small:
            words[row["slice"] * block // 64 : (row["slice"] + 1) * block // 64] = np.frombuffer(row["bits"], np.uint64)
        heads.append(np.frombuffer(row["head"], np.uint64))
        head_counts.append(np.frombuffer(row["head_counts"], np.int64))
    h, n = np.concatenate(heads), np.concatenate(head_counts)
    order = np.argsort(h)
    shared = LogFilter(words, bits, rules.hashes) if small else None
    return Model(shared, means, h[order], n[order], total, distinct, again / max(1, total), counts.select("slice", "hashes", "counts", "bits"), bits, kept)


CHUNKS = "chunk long, ids array<long>, sizes binary, texts binary"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk of documents: a number of its own, their ids, the bytes of each text, and all texts."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in tokens.chunks(batch, limit=CHUNK_BYTES, most_rows=CHUNK_ROWS):
            data, offsets = tokens.utf8(part.column("text"))
            ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([np.diff(offsets).astype("<i8").tobytes()]), pa.array([data.tobytes()], pa.binary())], names=["chunk", "ids", "sizes", "texts"])
            number += 1


def _chunk_tokens(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.frombuffer(batch.column("sizes")[i].as_buffer(), "<i8")
    return _tokens(np.frombuffer(batch.column("texts")[i].as_buffer() or b"", np.uint8), np.concatenate(([0], np.cumsum(sizes))))


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among the sorted ones, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


def score(docs: DataFrame, rules: Rules = Rules(), model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    A chunk asks the slices for the exact counts of its tokens outside of the head and, where the filter isn't
    broadcast, for the levels of its pairs: each once, packed by slice. The answers come back packed, in the same order.
    """
    model = model or train(docs, rules)
    bits, direct, counts = model.slice_bits, model.log_filter is not None, model.counts
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, counts=None))
    with scratch.batch_bytes(docs.sparkSession, BATCH_BYTES):
        chunks = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_chunked, CHUNKS), "chunks", GROUP_BYTES)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value.head
        for batch in batches:
            for i in range(len(batch)):
                h, _ = _chunk_tokens(batch, i)
                own = np.unique(np.append(h, END))
                tail = own[~_in(head, own)[1]]
                pairs = np.zeros(0, np.uint64) if direct else np.unique(bigrams(h, bits))
                a, b = _cuts(tail, bits), _cuts(pairs, bits)
                used = [s for s in range(1 << bits) if a[s] < a[s + 1] or b[s] < b[s + 1]]
                columns = [pa.array(used, pa.int32()), pa.array([batch.column("chunk")[i].as_py()] * len(used), pa.int64())]
                columns += [pa.array([tail[a[s] : a[s + 1]].tobytes() for s in used], pa.binary()), pa.array([_narrow(pairs[b[s] : b[s + 1]], bits) for s in used], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "chunk", "tail", "pairs"])

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        """All chunks' questions to a slice at once."""
        part = left.column("slice")[0].as_py() if len(left) else 0
        hashes, n = (np.frombuffer(b"".join(right.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("counts", np.int64)))
        words = np.frombuffer(b"".join(right.column("bits").to_pylist()), np.uint64)
        tails, pairs = left.column("tail").to_pylist(), left.column("pairs").to_pylist()
        at, known = _in(hashes, np.frombuffer(b"".join(tails), np.uint64))
        exact = np.where(known, n[at] if len(n) else 0, 0).astype("<i8").tobytes()
        asked = _widened(b"".join(pairs), bits, part)
        level = (LogFilter(words, 0, rules.hashes).level(asked) if len(words) else np.zeros(len(asked), np.uint8)).tobytes()
        ends, marks = np.cumsum([len(x) for x in tails], dtype=np.int64).tolist(), np.cumsum([len(x) // 4 for x in pairs], dtype=np.int64).tolist()
        made = [pa.array([raw[a:b] for a, b in zip([0, *to], to, strict=False)], pa.binary()) for raw, to in ((exact, ends), (level, marks))]
        return pa.table([left.column("slice"), left.column("chunk"), *made], names=["slice", "chunk", "exact", "levels"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        below = np.log10(model.total + model.distinct + 1.0)
        for batch in batches:
            for i in range(len(batch)):
                h, row = _chunk_tokens(batch, i)
                parts = sorted(batch.column("parts")[i].as_py() or [], key=lambda x: x["slice"])  # a slice is the hash's upper bits, so that the answers follow the sorted hashes
                exact, level = (np.frombuffer(b"".join(x[k] for x in parts), t) for k, t in (("exact", "<i8"), ("levels", np.uint8)))
                own, at = np.unique(np.append(h, END), return_inverse=True)
                place, known = _in(model.head, own)
                count = np.zeros(len(own), np.int64)
                count[known], count[~known] = model.head_counts[place[known]], exact
                count, end = count[at[:-1]], count[at[-1]]
                pair = bigrams(h, bits)
                level = model.log_filter.level(pair) if direct else level[np.unique(pair, return_inverse=True)[1]]
                n = len(batch.column("ids")[i])
                total = lambda x: np.bincount(row, weights=x, minlength=n)  # noqa: B023, E731
                columns = [total(None).astype(np.int64), total(count > 0).astype(np.int64), total(np.log10(count + 1.0) - below), total(model.logs(count, level, end))]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    asks = chunks.mapInArrow(asked, "slice int, chunk long, tail binary, pairs binary")
    answers = asks.groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(answered, "slice int, chunk long, exact binary, levels binary")
    parts = answers.groupBy("chunk").agg(F.collect_list(F.struct("slice", "exact", "levels")).alias("parts"))
    with scratch.batch_bytes(docs.sparkSession, BATCH_BYTES):
        scored = scratch.table(chunks.join(parts, "chunk", "left").mapInArrow(summed, "doc_id long, n_tokens long, n_known long, base_score double, score double"), "scores")
    scratch.drop(chunks)
    return scored.select("doc_id", (fold(F.col("doc_id"), rules.folds) == rules.held_out).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
