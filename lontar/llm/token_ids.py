"""Operator 8, token ids in a binary format.

Texts become ids with the tokenizers library, ids are counted over the whole corpus, and a canonical
Huffman code limited to 16 bits is built from the counts. Documents in ascending doc_id order fill
independent blocks; every block carries its documents' ids and lengths, and the bit offset of every
64th token, so that a decoder can start at any of these checkpoints and decode all of them side by side
with one table of 65,536 entries.

Block: magic "LHB1", uint32 documents, uint64 tokens, uint32 crc32 of the rest; then int64 doc_ids,
uint8 null flags, uint32 token counts, uint64 checkpoint bit offsets, uint64 words of the bit stream
(each word's most significant bit first). All numbers are little-endian. The code's lengths are stored
once for a file set, as uint8 by id.

Results for odd input: a null or empty text is the end id alone; documents with equal doc_id follow each
other in the order of their texts' hashes, null doc_ids first; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm import scratch, tokens

LIMIT = 16
STEP = 64
END_ID = 0
BLOCK_TOKENS = 1 << 20
MEMO_ENTRIES = 1_000_000
CHUNK_BYTES, CHUNK_ROWS, SLAB = 1_000_000, 4096, 200_000
GROUP = 2000
# Marks that may end a piece; the pre-tokenizer always cuts between a letter or digit and one of them.
_MARK, _PLAIN, _BLANK, _WHITE_END, _CUT = (np.zeros(256, bool) for _ in range(5))
_CUT[[0x20, *range(0x09, 0x0E)]] = True
_MARK[[ord(c) for c in ".,;:!?%$#&*+=/|)]}>\""]] = True
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_WHITE_END[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True  # last bytes of white space beyond ASCII
_HEAD = struct.Struct("<4sIQI")


class Encoder:
    """Ids by the tokenizers library, with a bounded memo of what it gave for each piece.

    The pre-tokenizer never joins white space to what stands before it, unless that is white space too, so a text cut
    before each run of white space, and before the marks that close a word, gives the same ids piece by piece. Texts
    that hold an added token's text go to the library whole. Pieces are known by 64-bit hashes of their bytes; the memo is
    sorted arrays of hashes and places in a pool of ids, and is begun anew with a chunk's own pieces when it is full.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.byte_lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a letter for each byte
        for token, i in vocabulary.items():
            self.byte_lengths[i] = len(token)
        self.keys, self.first, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of some pieces, where each begins there and how many it has; those led by white space are encoded some thousand as one text and cut by bytes."""
        led = np.array([_CUT[x[0]] and x[-1] < 0x80 and not _BLANK[x[-1]] for x in raw], bool)
        counts, order = np.zeros(len(raw), np.int64), np.argsort(~led, kind="stable")
        n = int(led.sum())
        groups = [[raw[i] for i in order[k : min(k + GROUP, n)].tolist()] for k in range(0, n, GROUP)]
        ids = self._encoded([b"".join(g).decode() for g in groups])
        for k, (group, got) in enumerate(zip(groups, ids, strict=True)):
            cuts = np.searchsorted(np.cumsum(self.byte_lengths[got]), np.cumsum([len(x) for x in group])) + 1
            counts[order[k * GROUP : k * GROUP + len(group)]] = np.diff(cuts, prepend=0)
        rest = self._encoded([raw[i].decode() for i in order[n:].tolist()])
        counts[order[n:]] = [len(x) for x in rest]
        first = np.empty(len(raw), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate([np.zeros(0, np.uint32), *ids, *rest]), first, counts

    def _known(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts of data, and how many each has."""
        own, sample, at = np.unique(tokens.word_hashes(data, start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, own)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != own) if len(self.keys) else np.arange(len(own))
        if len(new):
            if len(self.keys) + len(new) > MEMO_ENTRIES:
                self.keys, self.first, self.count, self.pool = self.keys[:0], self.first[:0], self.count[:0], self.pool[:0]
                return self._known(data, start, end) if len(new) < len(own) else self._learned(data, start, end, own, sample, at, new, place * 0)
            return self._learned(data, start, end, own, sample, at, new, place)
        return self._taken(place, at)

    def _learned(self, data, start, end, own, sample, at, new, place) -> tuple[np.ndarray, np.ndarray]:
        ids, first, counts = self._pieces([data[a:b].tobytes() for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist(), strict=True)])
        self.first = np.insert(self.first, place[new], len(self.pool) + first)
        self.count = np.insert(self.count, place[new], counts)
        self.keys = np.insert(self.keys, place[new], own[new])
        self.pool = np.concatenate((self.pool, ids))
        return self._taken(np.searchsorted(self.keys, own), at)

    def _taken(self, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[place][at]
        ends = np.cumsum(counts)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[place][at] - ends + counts, counts)
        return self.pool[index], counts

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text (null: none), without the end id."""
        data, offsets = tokens.utf8(column)
        n = len(column)
        if not len(data):
            return [np.zeros(0, np.uint32)] * n
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        space = _CUT[data]
        space[:1] = False
        space[1:] &= ~first[1:-1]
        places = np.flatnonzero(space)
        before = data[places - 1]
        odd = _BLANK[before] | (_WHITE_END[before] & (data[np.maximum(places - 2, 0)] >= 0x80))
        space[places[odd]] = False
        whole = np.zeros(n, bool)
        for word in self.added:
            whole |= pc.fill_null(pc.match_substring(column, word), False).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(space | first[:-1])
        row = np.searchsorted(offsets, start, "right") - 1
        end = np.append(start[1:], len(data))
        keep = ~whole[row]
        start, end, row = start[keep], end[keep], row[keep]
        marks = end.copy()
        for _ in range(3):
            more = (marks > start) & _MARK[data[marks - 1]]
            marks[more] -= 1
        last = data[np.maximum(marks - 1, 0)]
        lead = data[np.maximum(marks - 2, 0)]
        worded = _PLAIN[last] | ((last >= 0x80) & (last < 0xC0) & (((lead == 0xC3) & (last != 0x97) & (last != 0xB7)) | ((lead >= 0xC4) & (lead <= 0xC8))))
        closed = (marks < end) & (marks > start) & worded
        parts = 1 + closed.astype(np.int64)
        at = np.cumsum(parts) - parts
        starts, ends, rows = np.repeat(start, parts), np.repeat(end, parts), np.repeat(row, parts)
        ends[at[closed]] = marks[closed]
        starts[at[closed] + 1] = marks[closed]
        found = [self._known(data, starts[k : k + SLAB], ends[k : k + SLAB]) for k in range(0, len(starts), SLAB)]
        ids = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint32)
        sizes = np.bincount(rows, weights=np.concatenate([c for _, c in found]), minlength=n).astype(np.int64) if found else np.zeros(n, np.int64)
        out = np.split(ids, np.cumsum(sizes)[:-1])
        rest = np.flatnonzero(whole)
        for i, got in zip(rest.tolist(), self._encoded([column[i].as_py() for i in rest.tolist()]), strict=True):
            out[i] = got
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that its memo outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


TOKEN_SCHEMA = "doc_id long, tie long, n_tokens long, ids_crc32 long, ids binary"


def tokenize(docs: DataFrame, path: str, vocabulary: int, end_id: int = END_ID) -> DataFrame:
    """doc_id, a tie-breaker, the number of ids with the end id, their crc32 as uint32, and the ids (uint16 if they fit)."""
    kind = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in tokens.chunks(batch, limit=CHUNK_BYTES, most_rows=CHUNK_ROWS):
                ids = [np.append(x, np.uint32(end_id)) for x in encode(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("tie"),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4", copy=False)) for x in ids], pa.int64()),
                        pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "tie", "n_tokens", "ids_crc32", "ids"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "xxhash64(cast(text as string)) tie").mapInArrow(run, TOKEN_SCHEMA)


def id_counts(tokenized: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs: every task counts its rows into one array, and Spark adds the arrays by id (a vocabulary is bounded)."""
    kind = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            column = batch.column("ids").cast(pa.large_binary())
            _, at, data = column.buffers()
            if data is not None:
                at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] // kind.itemsize
                total += np.bincount(np.frombuffer(data, kind)[at[0] : at[-1]], minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for row in tokenized.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    rows = []
    level, single = weights, np.ones(n, bool)
    for _ in range(limit - 1):
        rows.append(single)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate((weights, pairs))
        at = np.argsort(merged, kind="stable")
        level, single = merged[at], at < n
    rows.append(single)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for single in reversed(rows):
        chosen = single[:take]
        leaves = int(chosen.sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


@dataclass(frozen=True)
class Codebook:
    """A canonical code: shorter codes first, equal lengths by id."""

    lengths: np.ndarray
    codes: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray) -> Codebook:
        lengths = np.asarray(lengths, np.uint8)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = np.int64(1) << (LIMIT - lengths[order].astype(np.int64))
        starts = np.concatenate(([0], np.cumsum(spans)[:-1])).astype(np.int64) if len(order) else np.zeros(0, np.int64)
        codes = np.zeros(len(lengths), np.uint64)
        codes[order] = (starts >> (LIMIT - lengths[order].astype(np.int64))).astype(np.uint64)
        table = np.zeros(1 << LIMIT, np.uint32)
        filled = np.repeat(order.astype(np.uint32) << np.uint32(5) | lengths[order].astype(np.uint32), spans)
        table[: len(filled)] = filled
        return Codebook(lengths, codes, table)


def pack_bits(ids: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """uint64 words of the bit stream, and the bit offset of every STEP-th token."""
    n = book.lengths[ids].astype(np.uint64)
    ends = np.cumsum(n, dtype=np.uint64)
    starts = ends - n
    words = np.zeros(int(ends[-1]) // 64 + 2 if len(ids) else 1, np.uint64)
    if len(ids):
        word, bit = (starts >> np.uint64(6)).astype(np.int64), starts & np.uint64(63)
        code = book.codes[ids]
        left = code << (np.uint64(64) - n)  # the code at the word's top
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] = np.bitwise_or.reduceat(left >> bit, first)
        over = np.flatnonzero(bit + n > np.uint64(64))
        words[word[over] + 1] |= left[over] << (np.uint64(64) - bit[over])
    return words, starts[::STEP].copy()


def unpack_bits(words: np.ndarray, checkpoints: np.ndarray, n: int, book: Codebook) -> np.ndarray:
    """n ids: all checkpoints advance together, a table lookup for each token."""
    out = np.zeros((STEP, len(checkpoints)), np.uint32)
    at = checkpoints.copy()
    table, lead, low = book.table, np.uint64(64 - LIMIT), np.uint64(63)
    streams = len(checkpoints)
    for k in range(min(STEP, n)):
        if k and n % STEP == k:
            streams = len(checkpoints) - 1  # the last checkpoint's tokens are done
            at = at[:streams]
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & low
        window = words[word] << bit | words[word + 1] >> np.uint64(1) >> (low - bit)
        entry = table[(window >> lead).astype(np.int64)]
        out[k, :streams] = entry >> np.uint32(5)
        at = at + (entry & np.uint32(31))
    return out.T.reshape(-1)[:n]


def encode_block(doc_ids: list[int | None], docs: list[np.ndarray], book: Codebook) -> bytes:
    ids = np.concatenate(docs)
    words, checkpoints = pack_bits(ids, book)
    body = b"".join(
        (
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], "u1").tobytes(),
            np.array([len(x) for x in docs], "<u4").tobytes(),
            checkpoints.astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
        )
    )
    return _HEAD.pack(b"LHB1", len(docs), len(ids), zlib.crc32(body)) + body


def decode_block(block: bytes, book: Codebook) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, token counts and all ids of a block."""
    magic, n_docs, n_ids, crc = _HEAD.unpack_from(block)
    if magic != b"LHB1" or zlib.crc32(memoryview(block)[_HEAD.size :]) != crc:
        raise ValueError("damaged block")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, null, counts = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    checkpoints = take("<u8", -(-n_ids // STEP))
    words = take("<u8", (len(block) - at) // 8)
    ids = unpack_bits(words, checkpoints, n_ids, book)
    return [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist(), strict=True)], counts, ids


BLOCK_SCHEMA = "part int, seq int, first_token long, n_docs long, n_tokens long, block binary"


@dataclass
class TokenFiles:
    """A written file set: its blocks' table in the shared folder, the code's lengths, and the tokens before each part."""

    blocks: DataFrame
    lengths: bytes
    starts: dict[int, int]


def write(docs: DataFrame, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> TokenFiles:
    """Encode docs into blocks of about block_tokens ids (a longer document fills its own), in ascending doc_id order."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    kind = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
    tokenized = scratch.table(tokenize(docs, path, vocabulary, end_id), "ids")
    lengths = code_lengths(id_counts(tokenized, vocabulary)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        book, part = Codebook.of(np.frombuffer(lengths, np.uint8)), TaskContext.get().partitionId()
        seq, done, waiting, doc_ids, docs = 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal seq, done, waiting, doc_ids, docs
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([done], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([waiting], pa.int64()), pa.array([encode_block(doc_ids, docs, book)], pa.binary())],
                names=["part", "seq", "first_token", "n_docs", "n_tokens", "block"],
            )
            seq, done, waiting, doc_ids, docs = seq + 1, done + waiting, 0, [], []
            return out

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                doc_ids.append(doc_id)
                docs.append(np.frombuffer(ids.as_buffer(), kind).copy())
                waiting += len(docs[-1])
                if waiting >= block_tokens:
                    yield flush()
        if docs:
            yield flush()

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokenized.rdd.getNumPartitions())
    ordered = tokenized.select("doc_id", "tie", "ids").repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    blocks = scratch.table(ordered.mapInArrow(run, BLOCK_SCHEMA), "blocks")
    scratch.drop(tokenized)
    starts, done = {}, 0
    for row in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row for each partition
        starts[row["part"]], done = done, done + row["n"]
    return TokenFiles(blocks, lengths, starts)


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _decoded(files: TokenFiles, schema: str, columns) -> DataFrame:
    lengths, starts = files.lengths, files.starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook.of(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for part, first, block in zip(batch.column("part").to_pylist(), batch.column("first_token").to_pylist(), batch.column("block"), strict=True):
                doc_ids, counts, ids = decode_block(block.as_buffer(), book)
                ends = np.cumsum(counts, dtype=np.int64)
                begins = ends - counts
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts[part] + first + begins, pa.int64()), pa.array(counts.astype(np.int64)), columns(ids.astype("<u4"), begins, ends)], names=[x.split()[0] for x in schema.split(", ")])

    return files.blocks.select("part", "first_token", "block").mapInArrow(run, schema)


def read_index(files: TokenFiles) -> DataFrame:
    """doc_id, first token's place in the whole set, token count and crc32 of the ids, decoded from the files."""
    return _decoded(files, READ_SCHEMA, lambda ids, a, b: pa.array([zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.int64()))


def read_ids(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and the ids themselves."""
    return _decoded(files, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids, a, b: pa.ListArray.from_arrays(pa.array(np.append(a, b[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32))))
