"""Mixing sources to target sizes by entropy balancing: exponentially tilted rates per document, rounded into copies.

A document may be taken 0 to ``CAP`` times. Among all rates with the wanted size per source, the rates sought have the largest entropy
(binomial, with the base rate 1). They are CAP * s(l * x), s the logistic function, x the size of the document in means of its source
and l the dual variable of the source: odds tilted exponentially by size. The dual is convex and solved by Newton's method, all sources at
once: documents of one size share a rate, so a step reads the table of (source, size, documents), and each source keeps a bracket that steps
may not leave. Sums are over rounded integers, so their order does not matter and reruns agree to the last copy.

Copies are rounded along segments of a source, larger documents first: each takes the number of copies nearest to what the segment should have
taken so far, so what a large document misses the smaller ones make up for, and a segment ends within about its smallest document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weekwise.operators.scan import row_numbers

from ._common import shared_table

WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
SHARE = 1.5  # of all sizes that the mix takes
CAP = 2  # copies of a document, and size of a source in the mix relative to its own
SEGMENT = 16_384  # documents that are rounded along one line, on average
STEPS = 200  # Newton steps at most; the bracket halves, so far fewer are needed
CLOSE = 1e-9  # relative distance from the target at which a source is solved
UNIT = 1 << 30  # rates are summed in units of 1 / UNIT
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, print, size): words of each whole text; print is a hash of the text that tells rows with equal ids apart."""
    words = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("bigint")
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[source].alias("source"), F.xxhash64(docs[text]).alias("print"), words.alias("size"))


def targets(measured: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, docs, source_size, target): ``share`` of all sizes dealt by weight, no source above ``cap`` times its own size.

    Sources in code point order, NULL last, take the weights in turn. The level that a unit of weight receives rises in rounds: sources
    that it fills stop, the rest share what is left, until none is above.
    """
    rows = shared_table(measured.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), "sources")
    placed = row_numbers(rows.where("source IS NOT NULL"), [], "source", "place")
    last = rows.where("source IS NULL").withColumn("place", placed.agg(F.count("*")).scalar() + 1)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = shared_table(placed.unionByName(last).withColumn("weight", pick).withColumn("most", cap * F.col("source_size")), "weights")
    total = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("most")
        done = rows.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if done[0] == full or not done[2]:
            break
        full, level = done[0], max(0.0, total - float(done[1])) / done[2]
    return rows.select("source", "docs", "source_size", F.least(F.col("weight") * F.lit(level), F.col("most")).cast("double").alias("target"))


def _rate(tilt: Column, size: Column, mean: Column, cap: float) -> Column:
    """Rate in units of 1 / UNIT; without a tilt (NULL: full) the cap."""
    odds = F.exp(-F.least(F.greatest(tilt * size / mean, F.lit(-700.0)), F.lit(700.0)))
    odds = odds * (cap - 1)  # the rate is 1 where nothing tilts
    return F.when(tilt.isNull(), F.lit(cap * UNIT)).otherwise(F.round(cap * UNIT / (1 + odds))).cast("bigint")


def solve(measured: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, tilt, mean): the dual variable of each source, NULL where the source is taken ``cap`` times as a whole, and its mean size.

    Newton steps on the dual of the entropy problem, one per source in each round, until every source meets its target to CLOSE.
    """
    table = shared_table(measured.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    mean = F.greatest(F.try_divide(F.col("source_size").cast("double"), F.col("docs").cast("double")), F.lit(1e-9))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    start = F.when(full, F.lit(None)).otherwise(F.lit(0.0)).cast("double")
    state = shared_table(wanted.select(
        "source", mean.alias("mean"), "target", start.alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        (full | (F.col("source_size") == 0)).alias("solved"),
    ), "duals")
    for _ in range(STEPS):
        left = state.where("NOT solved")
        if left.isEmpty():
            break
        cells = table.join(left.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
        words = (F.col("n") * F.col("size")).cast("decimal(19,0)")
        slope = F.round(rate * (1 - rate / (cap * UNIT)) * F.col("size") / F.col("mean") / (1 << 10)).cast("decimal(19,0)")
        sums = cells.groupBy("source").agg(
            (F.sum(words * rate.cast("decimal(12,0)")).cast("double") / UNIT).alias("size_now"),
            (F.sum(words * slope).cast("double") / (UNIT >> 10)).alias("slope_now"),
        ).withColumnRenamed("source", "s")
        at = left.join(sums, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        error = F.col("target") - F.col("size_now")
        low, high = F.when(error >= 0, F.col("tilt")).otherwise(F.col("low")), F.when(error <= 0, F.col("tilt")).otherwise(F.col("high"))
        at = at.withColumns({"error": error, "low": low, "high": high, "close": F.abs(error) <= F.lit(CLOSE) * F.col("target") + 1e-6})
        # a step stays within reach of what is known, and within the bracket: else the bracket is halved
        reach = 4 * F.greatest(F.lit(1.0), F.abs("tilt"))
        step = F.greatest(F.least(F.coalesce(F.try_divide("error", "slope_now"), F.signum("error") * reach), reach), -reach)
        there = F.col("tilt") + step
        inside = (F.col("low").isNull() | (there > F.col("low"))) & (F.col("high").isNull() | (there < F.col("high")))
        middle = (F.col("low") + F.col("high")) / 2
        at = at.withColumn("next", F.when(inside, there).otherwise(F.coalesce(middle, there)))
        stuck = F.col("next") == F.col("tilt")
        at = at.withColumns({"solved": F.col("close") | stuck, "tilt": F.when(F.col("close"), F.col("tilt")).otherwise(F.col("next"))})
        state = shared_table(state.where("solved").unionByName(at.select(*state.columns)), "duals")
    return state.select("source", "tilt", "mean")


def _copies(rows: DataFrame, cap: int) -> DataFrame:
    """Round the rates of each segment, in the order of the rows, so that what is taken follows what should be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, carry = None, 0
        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            size, rate = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = np.zeros(batch.num_rows, np.int32)
            for k, (name, x, r) in enumerate(zip(key, size, rate, strict=True)):
                if name != segment:
                    segment, carry = name, 0
                # whole numbers all the way: due is what the segment has still to take, in words times UNIT
                due = carry + x * r
                times = (2 * due + x * UNIT) // (2 * x * UNIT) if x else (2 * r + UNIT) // (2 * UNIT)
                out[k] = times = min(max(times, 0), cap)
                carry = due - times * x * UNIT
            names = ["doc_id", "size", "source", "source_size", "target", "rate", "copies"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (4, 2, 5, 6, 7, 3)] + [pa.array(out)], names)

    schema = "doc_id BIGINT, size BIGINT, source STRING, source_size BIGINT, target DOUBLE, rate BIGINT, copies INT"
    return rows.mapInArrow(run, schema)


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """(doc_id, size, source, source_size, target, rate, copies, taken): how often each document enters the mix.

    One row per input row; ``rate`` is the solved rate before rounding, ``taken`` the words that the copies hold. A NULL text has no
    words, NULL is a source of its own and comes last, repeated rows are documents of their own, a source without words has target 0. The
    mix takes at most ``cap`` copies of a document. An empty table gives an empty one. Other columns are not read.
    """
    measured = shared_table(sizes(docs, doc_id, text, source), "sizes")
    wanted = shared_table(targets(measured, weights, share, cap), "targets")
    duals = solve(measured, wanted, cap).withColumnRenamed("source", "s")
    plan = wanted.join(duals, wanted["source"].eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s")
    plan = shared_table(plan.withColumn("segments", F.ceil(F.col("docs") / SEGMENT)).withColumn("number", F.xxhash64("s", F.col("s").isNull())), "plan")
    rows = measured.join(plan, F.col("source").eqNullSafe(F.col("s")))
    rows = rows.select(
        "number", F.pmod(F.xxhash64("doc_id", "print", F.lit("segment")), "segments").alias("segment"), "size",
        _rate(F.col("tilt"), F.col("size"), F.col("mean"), cap).alias("rate"), "doc_id", "source", "source_size", "target", "print",
    )
    # sources whose numbers collide share lines; the order and the totals stay defined
    lines = rows.repartition("number", "segment").sortWithinPartitions(
        "number", "segment", F.desc("size"), F.xxhash64("doc_id", "print"), "doc_id", "print", "source"
    )
    found = _copies(lines.drop("print"), cap)
    return found.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("rate") / UNIT).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
