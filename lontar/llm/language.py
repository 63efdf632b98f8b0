"""Operator 5, language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: each of its slots is a bitmask of languages, and
the AND of an n-gram's slots names every language that has it. A text's popcount for each language, less what
false positives alone would give, decides.

The filter is fitted on a bounded sample of labelled rows (``sample_rows`` a language, in expectation, chosen by a
hash of the id); everything else covers all rows and whole texts. N-grams are of bytes of the lower-cased UTF-8
text, in which every run of other characters than letters counts as one space. A long text is gone through in pieces.

Results for odd input: a null text or one without a letter is ``und`` with score 0.0, as is every text if no row is
labelled; ties go to the first language by name; repeated rows get equal rows; a null doc_id counts as an empty one
for the fold; rows with a null lang or text aren't learned from. Other columns are ignored (``keep_identified``
keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lontar.llm import names, tokens

UNKNOWN = "und"


@dataclass(frozen=True)
class Rules:
    """N-gram lengths in bytes, sample rows a language, the share of a sample's texts and of the most frequent language's rate that puts an n-gram in a language's set, hashes, bytes and languages of a filter at most, and the least score to keep a document."""

    lengths: tuple[int, ...] = (3, 4)
    sample_rows: int = 1500
    least_share: float = 0.004
    least_rate: float = 0.25
    hashes: int = 3
    most_bytes: int = 1 << 27
    most_languages: int = 1000
    least_score: float = 0.25


_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(column: pa.Array, lengths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, rows) of all n-grams, length by length; those of one long text piece by piece."""
    data, offsets = tokens.utf8(column)
    if not len(data):
        return
    if len(column) > 1:
        yield from _grams(_LETTER[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), lengths)
        return
    data = _LETTER[data]
    data = data[np.concatenate(([True], (data[1:] > 0) | (data[:-1] > 0)))]
    for n in lengths:
        for at in range(0, len(data) - n + 1, tokens.PIECE_BYTES):
            part = data[at : at + tokens.PIECE_BYTES + n - 1]
            yield from _grams(part, np.zeros(len(part), np.int64), (n,))


def _grams(data: np.ndarray, row: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] > 0) | (data[:-1] > 0) | (row[1:] != row[:-1])
    data, row = data[keep].astype(np.uint64), row[keep]
    packed = data
    for n in range(2, max(lengths) + 1):
        packed = (packed[:-1] << np.uint64(8)) | data[n - 1 :]
        if n in lengths:
            same = row[n - 1 :] == row[: len(row) - n + 1]
            yield tokens.mix(packed[same] + np.uint64(n << 56)), row[: len(row) - n + 1][same]


def fold(doc_id: Column, folds: int = 4) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))) % folds


@dataclass
class LanguageFilter:
    """languages by bit, the slots (bitmasks, one column of words for each 64 languages) and each language's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    rules: Rules

    @staticmethod
    def of(languages: list[str], hashes: np.ndarray, gram: np.ndarray, lang: np.ndarray, rules: Rules) -> LanguageFilter:
        """gram, lang: places in hashes and languages, one pair for each n-gram of a language's set. Too many for most_bytes: ValueError."""
        wide = np.uint8 if len(languages) <= 8 else np.uint64
        size = np.dtype(wide).itemsize * 8
        words = max(1, -(-len(languages) // size))
        bits = max(10, (8 * max(1, len(hashes))).bit_length())
        if (words * np.dtype(wide).itemsize << bits) > rules.most_bytes:
            raise ValueError(f"a filter of {len(hashes)} n-grams and {len(languages)} languages is too large to broadcast")
        masks = np.zeros((len(hashes), words), wide)
        np.bitwise_or.at(masks, (gram, lang // size), wide(1) << (lang % size).astype(wide))
        slots = np.zeros((1 << bits, words), wide)
        for k in range(rules.hashes):
            np.bitwise_or.at(slots, LanguageFilter._place(hashes, k, bits), masks)
        rate = np.array([((slots[:, j // size] >> wide(j % size)) & wide(1)).mean() for j in range(len(languages))]) ** rules.hashes
        return LanguageFilter(languages, slots, rate, rules)

    @staticmethod
    def _place(h: np.ndarray, k: int, bits: int) -> np.ndarray:
        h = tokens.mix(h + np.uint64(k)) if k else h
        return (h & np.uint64((1 << bits) - 1)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The bitmask of the languages that have each n-gram (or seem to)."""
        bits = len(self.slots).bit_length() - 1
        found = self.slots[self._place(h, 0, bits)]
        for k in range(1, self.rules.hashes):
            found = found & self.slots[self._place(h, k, bits)]
        return found

    def decide(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its score for every row: its corrected count as a share of all languages'."""
        n = len(column)
        hits, total, size = np.zeros((n, len(self.languages))), np.zeros(n), self.slots.dtype.itemsize * 8
        for h, row in grams(column, self.rules.lengths):
            found = self.lookup(h)
            total += np.bincount(row, minlength=n)
            for j in range(len(self.languages)):
                bit = (found[:, j // size] >> found.dtype.type(j % size)) & found.dtype.type(1)
                hits[:, j] += np.bincount(row, weights=bit, minlength=n)
        corrected = np.clip((hits - total[:, None] * self.false_rate) / (1 - np.minimum(self.false_rate, 0.999)), 0, None)
        best = corrected.argmax(1)
        every = corrected.sum(1)
        score = np.divide(corrected.max(1), every, out=np.zeros(n), where=every > 0)
        return best, np.minimum(score, 1.0)


def fit(docs: DataFrame, rules: Rules = Rules()) -> LanguageFilter:
    """A filter from the labelled rows outside of the held-out fold."""
    labelled = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(rules.most_languages + 1).collect()}  # a row a language
    if len(counts) > rules.most_languages:
        raise ValueError(f"more than {rules.most_languages} languages")
    languages = sorted(counts)
    if not languages:
        return LanguageFilter.of([], *(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2), rules)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, rules.sample_rows / counts[lang])))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(chance < share[F.col("lang")]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch):
                codes = part.column("lang").dictionary_encode()
                own, code = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
                found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)), *grams(part.column("text"), rules.lengths)]
                h, row = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, bool)
                h, lang = h[new], code[row[new]]
                order = np.lexsort((h, lang))
                h, lang = h[order], lang[order]
                at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])))) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([own.take(pa.array(lang[at])), pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h))))], names=["lang", "gram", "n"])

    sizes = sample.groupBy("lang").agg(F.count("*").alias("size"))
    seen = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rates = seen.join(F.broadcast(sizes), "lang").withColumn("rate", F.col("n") / F.col("size")).filter((F.col("rate") >= rules.least_share) & (F.col("n") > 1))
    kept = rates.groupBy("gram").agg(F.collect_list(F.struct("lang", "rate")).alias("by"), F.max("rate").alias("most"))
    kept = kept.select("gram", F.transform(F.filter("by", lambda x: x["rate"] >= F.col("most") * rules.least_rate), lambda x: x["lang"]).alias("langs"))
    rows = kept.toArrow()  # bounded by the sample
    index = {lang: j for j, lang in enumerate(languages)}
    langs = rows.column("langs").combine_chunks()
    lengths = np.diff(langs.offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
    lang = np.array([index[x] for x in langs.flatten().to_pylist()], np.int64)
    return LanguageFilter.of(languages, rows.column("gram").to_numpy().view(np.uint64), np.repeat(np.arange(len(rows)), lengths), lang, rules)


def _predicted(staged: DataFrame, model: LanguageFilter) -> DataFrame:
    """staged, whose last columns are text and letter, with lang_pred and score in their place."""
    shared = staged.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*staged.schema.fields[:-2], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = pa.array([*model.languages, UNKNOWN], pa.string())
        for batch in batches:
            for part in tokens.chunks(batch):
                has = part.column("letter").to_numpy(zero_copy_only=False)
                best, value = model.decide(part.column("text")) if model.languages else (np.zeros(len(part), np.int64), np.zeros(len(part)))
                ok = has & bool(model.languages)
                best = np.where(ok, best, len(model.languages))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], known.take(pa.array(best)), pa.array(np.where(ok, value, 0.0))], names=schema.names)

    return staged.mapInArrow(run, schema)


def _staged(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return names.plain(docs, text=text, letter=F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, rules: Rules = Rules(), model: LanguageFilter | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = model or fit(docs, rules)
    out = _predicted(_staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("c1"), model)
    return out.select(F.col("c0").alias("doc_id"), (fold(F.col("c0")) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, rules: Rules = Rules(), model: LanguageFilter | None = None) -> DataFrame:
    """docs whose language is known with the least score at least."""
    out = _predicted(_staged(docs), model or fit(docs, rules))
    return names.restored(out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= rules.least_score)), docs)
