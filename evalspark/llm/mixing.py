"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order. A document's virtual
finish time is the source's words up to and including it, divided by the
source's target. Serving all queues by finish time gives every source its share
at any moment, so the mix is the order of finish times, cut where the words
served reach the total budget. A source whose target is above its size goes
round again: its documents queue a second and third time behind the first round.

Nothing is ordered in one task. Sums up to a document are those of whole ranges
of the shuffled order in front of it (a small table) plus those within its range;
the cut is found on a histogram of finish times and only documents in the range
of the cut are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import WORD, keep_table, packed, unpacked

CYCLE = (5, 2, 1)
MAX_REPEATS = 3
_RANGE_ROWS = 20_000
_STEPS = 1024  # ranges of finish times per unit of virtual time, at least; more when they would hold many documents


def word_count(text: Column) -> Column:
    """Words of a text: runs of other characters than ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Sources by code point, NULL last, get the weights of ``cycle`` in turn and share
    the sum of all sizes; a target stops at ``repeats`` times its source's size and
    what is left over is shared among the others by weight, until none is above.
    In closed form: with sources ordered by limit over weight, the share per weight
    is what the limited ones leave, divided by the weights of the rest; the limited
    ones are those in front of the first source that this share does not fill.
    The table has one row per source and is ordered in one task.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((place - 1) % len(cycle) + 1).cast("int"))
    weighed = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * repeats).cast("double").alias("limit"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    in_front, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("limit").over(in_front), F.lit(0.0))
    filled = weighed.withColumn("share", left / F.sum("weight").over(behind))
    unfilled = F.when(F.col("limit") >= F.col("share") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("share")))
    filled = filled.withColumn("level", F.min(unfilled).over(everything).getField("share"))
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return filled.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    cycle: tuple[int, ...] = CYCLE, repeats: int = MAX_REPEATS, seed: str = "mix",
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` (0 to ``repeats``) says how often the mix holds the document and
    ``taken`` = size * copies. The order within a source is that of the MD5 of
    ``seed`` and doc_id, so another run decides alike. A NULL source is a source
    of its own, behind the others; a NULL text has size 0 and is never taken.
    Rows with equal doc_id and source are told apart by size; rows equal in all
    three stand next to each other, and their copies are given to the first ones.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    sized = keep_table(
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`").cast("string")).alias("size"))
        .withColumn("key", key), "mix-sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = keep_table(source_targets(totals.select("source", "source_size"), cycle, repeats), "mix-targets")
    budget = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("b")).first().b
    n = sized.count()

    # Sums over the shuffled order: ranges of the 60-bit key, about as many rows in each.
    ranges = max(1, -(-n // _RANGE_ROWS))
    steps = max(_STEPS, ranges)
    sized = sized.withColumn("range", F.floor(F.col("key") / F.lit(2.0**60 / ranges)).cast("long"))
    in_range = sized.groupBy("source", "range").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_range.select(F.col("source").alias("s_source"), F.col("range").alias("s_range"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("range_start"))
    targets = targets.withColumnsRenamed({"source": "t_source"})
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sized.withColumn("upto", F.sum("size").over(within))
        .join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range")))
        .join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .select("doc_id", "source", "size", "key", "source_size", "target", (F.col("range_start") + F.col("upto")).alias("upto"))
    )
    # The queues close at virtual time 1, when each source has had its target: what begins
    # earlier is in. All that finishes by then fits into the budget, the rest is cut below.
    last = F.least(F.lit(repeats - 1), F.floor(F.col("target") / F.col("source_size")).cast("int"))
    rounds = F.when(F.col("target") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    queued = (
        placed.filter("size > 0").withColumn("round", F.explode(rounds))
        .filter(F.col("round") * F.col("source_size") + F.col("upto") - F.col("size") < F.col("target"))
        .withColumn("finish", (F.col("round") * F.col("source_size") + F.col("upto")) / F.col("target"))
        .withColumn("step", F.floor(F.col("finish") * steps).cast("long"))
    )
    queued = keep_table(queued.select("doc_id", "source", "size", "key", "upto", "round", "finish", "step"), "mix-queue")
    # A row per step and per source for a document that finishes later: one for some 20,000 documents.
    served = queued.groupBy("step").agg(F.sum("size").alias("s"))
    running = served.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = running.filter((F.col("before") <= budget) & (F.col("before") + F.col("s") > budget)).orderBy("step").first()
    if cut is None:
        taken = queued
    else:
        order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "key", "doc_id", "size", "round").rowsBetween(Window.unboundedPreceding, 0)
        at_cut = queued.filter(F.col("step") == cut.step).withColumn("total", F.sum("size").over(order) + cut.before).filter(F.col("total") <= budget).drop("total")
        taken = queued.filter(F.col("step") < cut.step).unionByName(at_cut)
    copies = taken.groupBy("doc_id", "source", "size", "upto").agg(F.count("*").alias("copies"))
    copies = copies.toDF("c_doc_id", "c_source", "c_size", "c_upto", "copies")
    joined = placed.join(
        copies,
        F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("upto") == F.col("c_upto")),
        "left",
    )
    copies = F.coalesce(F.col("copies"), F.lit(0))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in no particular order."""
    plan = mix(docs, doc_id, text, source, **settings).filter("copies > 0")
    same = Window.partitionBy("doc_id", "source", "size")
    numbered = plan.withColumn("nth", F.row_number().over(same.orderBy(F.desc("copies"))))
    numbered = numbered.select(*[F.col(c).alias(f"p_{c}") for c in ("doc_id", "source", "size", "nth", "copies")])
    rows = packed(
        docs, doc_id=F.col(f"`{doc_id}`"), source=F.col(f"`{source}`").cast("string"), size=word_count(F.col(f"`{text}`").cast("string")),
    ).withColumn("nth", F.row_number().over(same.orderBy(F.xxhash64(F.col(f"row.`{text}`")))))
    match = F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("nth") == F.col("p_nth"))
    taken = rows.join(numbered, match).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("p_copies"))))
    return unpacked(taken, docs.columns)
