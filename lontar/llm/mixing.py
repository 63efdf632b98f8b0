"""Operator 3, mixing sources to target weights, by weighted fair queueing, in DataFrame operations only.

Every source's documents are shuffled by a keyed digest of their id. A document's virtual finish time is the
number of its source's words up to its end, divided by the source's target; a second pass over a source goes
on from where the first one ended. All sources are then ordered together by that time and the schedule is cut
where the total budget is reached, so each source has got its share whenever one stops.

Sums along a source's order are taken in three levels (512 coarse ranges of the digest, fine ranges of about
2,000 documents, documents), so a source with most of the rows has no task of its own. The cut comes from
sums over equal slots of the time line; only the slot in which the budget falls is looked into.

Results for odd input: a null or empty text has size 0 and takes no words; a null source is one source, last
in order; rows of one source with equal doc_id are taken together; without any words all targets are 0.0; an
empty table gives an empty one. Other columns are ignored by ``schedule`` and kept by ``mix_documents``, whatever their
names. A very long text only counts its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.llm import names, scratch

WORD = r"[^\x20\x09-\x0D]+"
COARSE_BITS = 9
FINE_DOCS = 2000
SLOTS = 1 << 10
LEVELS = 3


@dataclass(frozen=True)
class Mix:
    """Weights by rank of the source (repeating), budget as a share of all words, passes at most, and the shuffle's key."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    passes: int = 2
    seed: str = "lontar"


def _queue() -> Column:
    """A key of the source that is never null and sorts as the source does, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))


def sizes(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, queue, size and the shuffle's digest with its first 40 bits as a number."""
    digest = F.md5(F.concat(F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _queue().alias("queue"), size.alias("size"), digest.alias("digest")).withColumn("at", F.conv(F.substring("digest", 1, 10), 16, 10).cast("long"))


def targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """queue, source_size and target of every source (a row each).

    With r = cap / weight in ascending order, the level once all smaller sources stand at their caps is
    (budget - their caps) / (the other weights); it is greatest where no further source is capped.
    """
    by_source = sized.groupBy("queue").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("queue")) - 1
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    ranked = by_source.withColumn("weight", F.element_at(weights, (rank % len(mix.weights) + 1).cast("int"))).withColumn("cap", F.col("source_size").cast("double") * mix.passes)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "queue")
    every = Window.partitionBy()
    budget = F.sum("source_size").over(every).cast("double") * mix.share
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    others = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return ranked.withColumn("level", (budget - capped) / others).select("queue", "source_size", F.least("cap", F.col("weight") * F.max("level").over(every)).alias("target"))


def _queued(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """sized plus source_size, target and ``done``: the source's words up to each document's end in its shuffled order."""
    fine = sized.count() // (FINE_DOCS << COARSE_BITS) + 1
    low = 40 - COARSE_BITS
    keyed = sized.withColumn("coarse", F.shiftright("at", low)).withColumn("fine", F.shiftright(F.col("at").bitwiseAND((1 << low) - 1) * fine, low))
    up_to = (Window.unboundedPreceding, -1)
    by_fine = keyed.groupBy("queue", "coarse", "fine").agg(F.sum("size").alias("n"))
    by_coarse = by_fine.groupBy("queue", "coarse").agg(F.sum("n").alias("n"))
    coarse_before = by_coarse.select("queue", "coarse", F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("coarse").rowsBetween(*up_to)), F.lit(0)).alias("a"))
    fine_before = by_fine.select("queue", "coarse", "fine", F.coalesce(F.sum("n").over(Window.partitionBy("queue", "coarse").orderBy("fine").rowsBetween(*up_to)), F.lit(0)).alias("b"))
    offsets = fine_before.join(coarse_before, ["queue", "coarse"]).join(wanted, "queue").select("queue", "coarse", "fine", (F.col("a") + F.col("b")).alias("before"), "source_size", "target")
    inside = F.sum("size").over(Window.partitionBy("queue", "coarse", "fine").orderBy("digest", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return keyed.withColumn("inside", inside).join(offsets, ["queue", "coarse", "fine"]).withColumn("done", F.col("before") + F.col("inside"))


def _finish(mix: Mix) -> list[Column]:
    """A document's virtual finish time in each pass."""
    return [(F.col("done") + k * F.col("source_size")).cast("double") / F.col("target") for k in range(mix.passes)]


def _cut(queued: DataFrame, wanted: DataFrame, mix: Mix) -> float:
    """The earliest virtual finish time at which the words taken exceed the budget (infinite if none does)."""
    total = wanted.agg(F.sum("target").alias("budget"), F.max(F.when(F.col("target") > 0, F.col("source_size") * float(mix.passes) / F.col("target"))).alias("last")).first()
    if not total["last"]:
        return float("inf")
    copies = queued.filter("size > 0 and target > 0").select("size", F.explode(F.array(*_finish(mix))).alias("finish"))
    low, width, before = 0.0, total["last"] / SLOTS, 0
    for _ in range(LEVELS):
        slot = F.greatest(F.lit(0), F.least(F.lit(SLOTS - 1), F.floor((F.col("finish") - low) / width)))
        sums = {r["slot"]: r["n"] for r in copies.groupBy(slot.alias("slot")).agg(F.sum("size").alias("n")).collect()}  # SLOTS rows at most
        k = 0
        while k < SLOTS and before + sums.get(k, 0) <= total["budget"]:
            before += sums.get(k, 0)
            k += 1
        copies = copies.filter(slot == k)
        low, width = low + k * width, width / SLOTS
    running = F.sum("n").over(Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    late = copies.groupBy("finish").agg(F.sum("size").alias("n")).withColumn("run", running).filter(F.col("run") + before > total["budget"])
    found = late.agg(F.min("finish").alias("f")).first()["f"]
    return float("inf") if found is None else found


def _scheduled(docs: DataFrame, mix: Mix) -> DataFrame:
    sized = scratch.checkpoint(sizes(docs, mix))
    wanted = scratch.checkpoint(targets(sized, mix))
    queued = scratch.checkpoint(_queued(sized, wanted))
    cut = _cut(queued, wanted, mix)
    copies = sum((F.when((F.col("size") > 0) & (f < cut), 1).otherwise(0) for f in _finish(mix)), F.lit(0))
    return queued.withColumn("copies", copies).withColumn("finish", _finish(mix)[0])


def schedule(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words of each document that the mix takes, repeats counted."""
    return _scheduled(docs, mix).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, mix: Mix = Mix(), ordered: bool = True) -> DataFrame:
    """The mixed corpus: docs' columns, each taken document once for each pass that takes it, sorted by virtual finish time."""
    plan = _scheduled(docs, mix).filter("copies > 0")
    times = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: (F.col("done") + k * F.col("source_size")).cast("double") / F.col("target"))
    plan = plan.groupBy("queue", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")).agg(F.max(times).alias("times"))
    keyed = names.plain(docs, queue=_queue(), id=F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    taken = keyed.join(plan, ["queue", "id"]).withColumn("time", F.explode("times"))
    if ordered:
        taken = taken.repartitionByRange("time", "id").sortWithinPartitions("time", "id")
    return names.restored(taken, docs)


ORACLE_SQL = r"""
with sized as (
  select doc_id, source, md5(concat('lontar', coalesce(cast(doc_id as varchar), ''))) digest,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size
  from documents),
by_source as (
  select source, cast(sum(size) as bigint) source_size,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end weight
  from sized group by source),
levels as (
  select *, source_size * 2.0::double cap,
    (cast(sum(source_size) over () as double) * 1.5::double
      - coalesce(sum(source_size * 2.0::double) over (order by source_size * 2.0::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(weight) over (order by source_size * 2.0::double / weight, source nulls last rows between current row and unbounded following) as level
  from by_source),
wanted as (select source, source_size, least(cap, weight * max(level) over ()) target from levels),
queued as (
  select s.doc_id, s.size, w.source_size, w.target, cast(sum(s.size) over (partition by s.source order by s.digest, s.doc_id) as bigint) done
  from sized s join wanted w on s.source is not distinct from w.source),
copies as (
  select size, cast(done + k * source_size as double) / target finish
  from queued, (values (0), (1)) passes(k) where size > 0 and target > 0),
late as (select finish, sum(size) over (order by finish) run from copies),
cut as (select coalesce(min(finish), 'infinity'::double) stop from late where run > (select sum(target) from wanted))
select doc_id, size, source_size, target,
  cast(case when size > 0 then size * ((case when cast(done as double) / target < stop then 1 else 0 end) + (case when cast(done + source_size as double) / target < stop then 1 else 0 end)) else 0 end as bigint) taken
from queued, cut
"""
