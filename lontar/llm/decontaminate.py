"""Operator 4, benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words inside a sentence) and units (unit words after a number) of benchmark items
and documents become typed placeholders; windows of eight template tokens are hash-joined. Where windows of an
item follow each other in a document, equal values of the item must stand for equal values of the document; windows
that hold a value which doesn't are left out, the others count (different values may become equal). So verbatim
passages and re-parameterised questions are found alike, and a template that is only filled by chance is not. An item
counts as leaked into a document when enough of its windows are found that way, or when a run of twice the window's
tokens stands there with the item's own values.

The template of a window without four literal tokens (for items of under eight tokens: three) identifies nothing. Every
window also has an exact hash of its tokens, values included, so that verbatim passages of figures and names are found
too; the template windows found count as a share of the item's template windows, all windows as a share of all. So
that changed words cost no more than themselves, an item also leaks when windows and verbatim runs of four tokens, in
one alignment without conflicting values, cover that share of its tokens.

Results for odd input: null or empty texts and items have no windows and never match; items of under three
tokens can't be searched for; repeated documents or items give a row each pair of ids; null ids stay null; a
doc_id with different texts is judged by each text; a very long text is a chunk of its own, at about 20 bytes of memory a
byte. Other columns are ignored (``drop_contaminated`` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm import keyed, names, scratch, tokens

# Unit words.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons lb lbs oz ml l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years mph kmh kph "
    "usd eur gbp dollar dollars euro euros pound pounds cent cents percent pct degree degrees celsius fahrenheit kelvin "
    "w kw mw v kv a ma hz khz mhz ghz j kj cal kcal pa kpa bar n kb mb gb tb byte bytes bit bits"
)


@dataclass(frozen=True)
class Rules:
    """Window length, literal tokens it needs, tokens of a short item and of a verbatim run at least, share of an item's windows or tokens that make a leak, and the limits of what is broadcast."""

    window: int = 8
    literals: int = 4
    shortest: int = 3
    seed: int = 4
    share: float = 0.5
    filter_bits: int = 28
    broadcast_rows: int = 20_000


_DIGIT, _UPPER, _STOP, _POINT, _WORD = (np.zeros(256, bool) for _ in range(5))
_DIGIT[48:58] = True
_UPPER[65:91] = True
_STOP[[ord(c) for c in ".!?:\n"]] = True
_POINT[[ord("."), ord(",")]] = True
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_EXACT = np.uint64(0x9FB21C651E98DF25)
_KINDS = tokens.mix(np.arange(0x5107, 0x510B, dtype=np.uint64))


def _hash_of_words(words: str) -> np.ndarray:
    data, offsets = tokens.utf8(pa.array([words]))
    start, end, _ = tokens.word_bounds(data, offsets)
    return np.sort(tokens.word_hashes(data, start, end))


def templates(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, literal hash, slot kind (0 literal, 1 number, 2 name, 3 unit) and row of every token."""
    data, offsets = tokens.utf8(column)
    none = np.zeros(0, np.uint64)
    if not len(data):
        return none, none, np.zeros(0, np.int8), np.zeros(0, np.int64)
    digit = _DIGIT[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    word = _WORD[data]
    inner = _POINT[data]
    inner[0] = inner[-1] = False
    inner[1:-1] &= digit[:-2] & digit[2:]
    inner[1:] &= ~first[1:]
    inner[:-1] &= ~first[1:]  # the digits on both sides are in the same text
    numeral = digit | inner
    word |= inner
    cut = np.ones(len(data), bool)
    cut[1:] = first[1:] | ~word[:-1] | (numeral[1:] != numeral[:-1])
    start = np.flatnonzero(word & cut)
    ends = np.ones(len(data), bool)
    ends[:-1] = cut[1:] | ~word[1:]
    end = np.flatnonzero(word & ends) + 1
    lower = tokens.lower_ascii(data)
    accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    capital = _UPPER[data]
    capital[accent - 1] = True
    if len(accent):
        lower[accent] += 32
    literal = tokens.word_hashes(lower, start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    number = numeral[start]
    stops = np.concatenate(([0], np.cumsum(_STOP[data], dtype=np.int32)))
    opening = np.ones(len(start), bool)
    opening[1:] = (row[1:] != row[:-1]) | (stops[start[1:]] > stops[end[:-1]])
    name = capital[start] & ~opening
    after = np.zeros(len(start), bool)
    after[1:] = number[:-1] & (row[1:] == row[:-1])
    units = _hash_of_words(UNITS)
    unit = np.zeros(len(start), bool)
    near = np.flatnonzero(after & ~number)
    unit[near] = np.isin(literal[near], units)
    kind = np.select([number, unit, name], [1, 3, 2], 0).astype(np.int8)
    return np.where(kind > 0, _KINDS[kind], literal), literal, kind, row


@dataclass
class Windows:
    """Hash, first token, length and sort of the windows that identify something: by their template, or by their very tokens."""

    h: np.ndarray
    at: np.ndarray
    n: np.ndarray
    exact: np.ndarray


def windows(template: np.ndarray, literal: np.ndarray, kind: np.ndarray, row: np.ndarray, n_rows: int, rules: Rules, lengths: list[int], short_only: bool) -> Windows:
    """Windows of the given lengths; short_only: those under the full length only for rows of just that many tokens (the items)."""
    per_row = np.bincount(row, minlength=n_rows)
    literals = np.concatenate(([0], np.cumsum(kind == 0)))
    found: list[tuple] = []
    for n in lengths:
        h, at = tokens.windows(template, row, n)
        keep = literals[at + n] - literals[at] >= (rules.literals if n == rules.window else rules.shortest)
        whole = per_row[row[at]] == n if n < rules.window and short_only else np.ones(len(at), bool)
        keep &= whole
        found.append((h[keep], at[keep], np.full(int(keep.sum()), n), np.zeros(int(keep.sum()), bool)))
        h = tokens.mix(tokens.windows(literal, row, n)[0] ^ _EXACT)
        found.append((h[whole], at[whole], np.full(int(whole.sum()), n), np.ones(int(whole.sum()), bool)))
        if n == rules.seed and short_only:
            part = per_row[row[at]] >= rules.window
            found.append((h[part], at[part], np.full(int(part.sum()), n), np.ones(int(part.sum()), bool)))
    return Windows(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _slots(w: Windows, literal: np.ndarray, kind: np.ndarray) -> pa.Array:
    """The values in each window's slots, in order."""
    slots = np.flatnonzero(kind > 0)
    a, b = np.searchsorted(slots, w.at), np.searchsorted(slots, w.at + w.n)
    offsets = np.concatenate(([0], np.cumsum(b - a)))
    index = np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(literal[slots[index]].view(np.int64)))


def item_windows(benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """item_id, place, n_template, n_windows and n_tokens of its item, length, hash, sort and slot values of every benchmark window."""
    lengths = list(range(rules.shortest, rules.window + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch):
                template, literal, kind, row = templates(part.column("text"))
                w = windows(template, literal, kind, row, len(part), rules, lengths, True)
                rows = row[w.at] if len(w.at) else np.zeros(0, np.int64)
                size = np.bincount(row, minlength=len(part))
                seed = (w.n < rules.window) & (size[rows] >= rules.window)
                by_template, count = (np.bincount(rows[(w.exact == x) & ~seed], minlength=len(part)) for x in (False, True))  # each place has an exact window
                begin = np.searchsorted(row, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(pa.array(rows)), pa.array(w.at - begin), pa.array(by_template[rows].astype(np.int64)), pa.array(count[rows].astype(np.int64)), pa.array(size[rows].astype(np.int64)), pa.array(w.n.astype(np.int32)), pa.array(w.h.view(np.int64)), pa.array(w.exact), pa.array(seed), _slots(w, literal, kind)],
                    names=["item_id", "place", "n_template", "n_windows", "n_tokens", "length", "hash", "by_tokens", "seed", "slots"],
                )

    return benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").mapInArrow(run, "item_id long, place long, n_template long, n_windows long, n_tokens long, length int, hash long, by_tokens boolean, seed boolean, slots array<long>")


def _longest_run(places: Column) -> Column:
    """How many numbers of an array follow each other without a gap, at most."""
    start = F.struct(F.lit(-2).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"] + 1, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(F.array_distinct(places)), start, step, lambda s: s["best"])


def _covered(hits: Column) -> Column:
    """How many tokens the (place, length) pairs of an array cover."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        end = F.greatest(s["end"], x["place"] + x["length"])
        return F.struct(end.alias("end"), (s["n"] + end - F.greatest(s["end"], x["place"])).alias("n"))

    return F.aggregate(F.array_sort(hits), start, step, lambda s: s["n"])


def leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, node (the text's hash), item_id, n_found, n_windows, exact and score (share of windows or of tokens, the greater) of each item leaked into a document."""
    items = scratch.checkpoint(item_windows(benchmark, rules))
    spark = docs.sparkSession
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most the window's length
    words = spark.sparkContext.broadcast(keyed.key_bits(items.select("hash").distinct(), "hash", rules.filter_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch):
                template, literal, kind, row = templates(part.column("text"))
                w = windows(template, literal, kind, row, len(part), rules, lengths, False) if lengths else Windows(*(np.zeros(0, np.int64),) * 4)
                keep = keyed.may_hold(words.value, w.h) if len(w.h) else np.zeros(0, bool)
                w = Windows(w.h[keep], w.at[keep], w.n[keep], w.exact[keep])
                if not len(w.h):
                    continue
                rows = pa.array(row[w.at])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("node").take(rows), pa.array(w.at - np.searchsorted(row, row[w.at])), pa.array(w.n.astype(np.int32)), pa.array(w.h.view(np.int64)), _slots(w, literal, kind)],
                    names=["doc_id", "node", "at", "length", "hash", "values"],
                )

    source = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) node", "cast(text as string) text")
    hits = source.mapInArrow(run, "doc_id long, node long, at long, length int, hash long, values array<long>").distinct()
    side = F.broadcast(items) if items.count() <= rules.broadcast_rows else items
    met = hits.join(side, ["hash", "length"]).withColumn("shift", F.col("at") - F.col("place"))
    own = F.transform("slots", lambda v: F.struct(v.alias("i"), v.alias("d")))
    pairs = F.when(F.col("by_tokens"), own).otherwise(F.transform(F.arrays_zip("slots", "values"), lambda p: F.struct(p["slots"].alias("i"), p["values"].alias("d"))))
    item = ["doc_id", "node", "item_id", "n_template", "n_windows", "n_tokens"]
    aligned = met.groupBy(*item, "shift").agg(F.collect_set(F.struct("place", "length", "by_tokens", "seed", pairs.alias("pairs"))).alias("hits"))
    values = F.transform(F.array_distinct(F.flatten(F.transform(F.filter("hits", lambda h: ~h["by_tokens"]), lambda h: h["pairs"]))), lambda p: p["i"])  # as the templates have them
    aligned = aligned.withColumn("values", values).withColumn("torn", F.filter(F.array_distinct("values"), lambda i: F.size(F.filter("values", lambda v: v == i)) > 1))
    good = F.filter("hits", lambda h: ~F.arrays_overlap(F.transform(h["pairs"], lambda p: p["i"]), F.col("torn")))
    verbatim = F.filter("hits", lambda h: h["by_tokens"] & ~h["seed"])
    covered = F.when(F.size("torn") == 0, _covered(F.transform("hits", lambda h: F.struct(h["place"], h["length"])))).otherwise(F.lit(0).cast("long"))
    aligned = aligned.select(*item, covered.alias("covered"), F.filter(good, lambda h: ~h["seed"]).alias("good"), _longest_run(F.transform(verbatim, lambda h: h["place"])).alias("run"))
    by_template = F.filter("good", lambda h: ~h["by_tokens"])
    aligned = aligned.select(*item, "run", "covered", F.transform("good", lambda h: h["place"]).alias("places"), F.transform(by_template, lambda h: h["place"]).alias("templates"), F.forall("good", lambda h: F.forall(h["pairs"], lambda p: p["i"] == p["d"])).alias("same"))
    number = lambda name: F.size(F.array_distinct(F.flatten(F.collect_list(name)))).cast("long")
    found = aligned.groupBy(*item).agg(number("places").alias("n_all"), number("templates").alias("n_by_template"), F.min("same").alias("exact"), F.max("run").alias("run"), F.max("covered").alias("covered"))
    share, over_all = F.coalesce(F.try_divide("n_by_template", "n_template"), F.lit(0.0)), F.col("n_all") / F.col("n_windows")
    counted = F.when(share >= over_all, F.struct(F.col("n_by_template").alias("n_found"), F.col("n_template").alias("n_windows"), share.alias("score"))).otherwise(F.struct(F.col("n_all").alias("n_found"), "n_windows", over_all.alias("score")))
    found = found.withColumn("c", counted).withColumn("score", F.greatest("c.score", F.col("covered") / F.col("n_tokens"))).withColumn("exact", F.col("exact") & (F.col("n_all") > 0)).filter((F.col("score") >= rules.share) | (F.col("run") > rules.window))
    return found.select("doc_id", "node", "item_id", "c.n_found", "c.n_windows", "exact", "score")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs without the documents that an item leaked into."""
    bad = scratch.checkpoint(leaks(docs, benchmark, rules).select("node", "doc_id").distinct())
    staged = names.plain(docs, node=F.xxhash64(F.col("text").cast("string")), doc_id=F.col("doc_id").cast("long"))
    return names.restored(keyed.without(staged, "node", bad, ["node", "doc_id"]), docs)
