"""Mixing sources to target weights by entropy balancing.

Each document gets a rate w (copies expected in the mix).  The rates are those of
least divergence from 1 that meet every source's word target with no rate above
``MAX_RATE``; they are exponential tilts w = min(MAX_RATE, exp(lambda * size /
mean size)), with one multiplier for each source.  The multipliers solve the
convex dual by Newton steps, each one aggregate over (source, size, count) rows;
a bracket that always holds the root catches steps that would leave it.  Rates
become whole copies by carrying the rounding error from large to small documents
in salted groups, so a source misses its target by less than half of a small text a group.
Equal rows are one unit whose total is rounded; some of its rows then take one copy more
than the others, so no row count is too large to round well.

Defined cases: a null text has size 0, a rate of 1 and adds no words; null is a
source of its own, last in order; rows that repeat an id with the same size and
source are rounded together, and which of them take one copy more is left to chance; an empty table gives an empty mix; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlens.llm.common import fresh, numbered, store, text_key, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_RATE = 2.0
# documents expected in a group whose rounding errors are carried together
GROUP = 4096
TOLERANCE = 1e-9
MAX_STEPS = 60
# rows of a unit that are made from one row at a time
PIECE = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (of the source), size in words; stored."""
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return store(d.select("doc_id", "source", text_key("source").alias("key"), word_count("text").alias("size")),
                 "mix-sizes")


def targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """key, source, source_size, n_docs, target for the rows of ``sizes``.

    Weights repeat over the sources in code point order, null last.  Targets share
    the whole by weight; what lies above max_rate times a source is shared again.
    """
    per = docs.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    at = F.pmod(F.col("index"), F.lit(len(weights))).cast("int")
    src = store(numbered(per, ["source"], "mix-order")
                .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1)), "mix-sources")
    most = F.col("source_size") * F.lit(max_rate)
    level = 0.0
    while True:
        # sources that the present level fills, and what is left for the others
        full = most <= F.lit(level) * F.col("weight")
        r = src.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, most)).alias("used"),
                    F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if not r.free:
            break
        new = (share * r["all"] - (r.used or 0.0)) / r.free
        if new <= level:
            break
        level = new
    return src.withColumn("target", F.least(most, F.lit(level) * F.col("weight"))).drop("weight", "index")


def multipliers(docs: DataFrame, goal: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """The dual solution: key, lam and mean, for every source."""
    hist = store(docs.filter("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    # the root lies between the tilt that alone takes texts of one word down to the
    # target and the one that takes them up to the largest rate
    state = store(
        goal.filter("source_size > 0")
        .withColumn("mean", F.col("source_size") / F.col("n_docs"))
        .select("key", "target", "mean", F.lit(0.0).alias("lam"),
                F.least(F.lit(0.0), F.col("mean") * F.log(F.col("target") / F.col("source_size"))).alias("lo"),
                (F.col("mean") * math.log(max_rate)).alias("hi"),
                # a source that is taken whole at the largest rate needs no solution
                (F.col("target") >= F.col("source_size") * max_rate * (1 - TOLERANCE)).alias("done")), "mix-state")
    for _ in range(MAX_STEPS):
        tilt = F.least(F.lit(max_rate), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))))
        words = F.col("n") * F.col("size") * tilt
        step = (hist.join(state.filter("not done"), "key")
                .groupBy("key").agg(F.sum(words).alias("f"),
                                    F.sum(F.when(tilt < max_rate, words * F.col("size") / F.col("mean"))).alias("slope")))
        miss = F.col("f") - F.col("target")
        lo = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - miss / F.col("slope")
        state = store(
            state.join(step, "key", "left")
            .withColumns({"met": F.abs(miss) <= F.lit(TOLERANCE) * F.col("target"), "lo2": lo, "hi2": hi})
            .withColumn("next", F.when((newton > F.col("lo2")) & (newton < F.col("hi2")), newton)
                        .otherwise((F.col("lo2") + F.col("hi2")) / 2))
            .select("key", "target", "mean",
                    F.when(F.col("done") | F.col("met"), F.col("lam")).otherwise(F.col("next")).alias("lam"),
                    F.when(F.col("done"), F.col("lo")).otherwise(F.col("lo2")).alias("lo"),
                    F.when(F.col("done"), F.col("hi")).otherwise(F.col("hi2")).alias("hi"),
                    (F.col("done") | F.col("met")).alias("done")), "mix-state")
        if state.filter("not done").isEmpty():
            break
    else:
        raise RuntimeError(f"{state.filter('not done').count()} sources did not reach their target in {MAX_STEPS} steps")
    whole = F.col("target") >= F.lit(max_rate) * F.col("source_size") * (1 - TOLERANCE)
    return (goal.join(state.select("key", "lam", "mean"), "key", "left")
            .withColumn("whole", whole & (F.col("source_size") > 0)))


def rates(docs: DataFrame, solved: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """The tilted rate of every row of ``sizes``."""
    tilt = F.least(F.lit(max_rate), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))))
    return (docs.join(solved.drop("source"), "key")
            .withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0))
                        .when(F.col("whole"), F.lit(max_rate)).otherwise(tilt)))


def round_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of one group's units in all, the error carried from large to small.

    What is left at the end is worked off by single copies, again from large to
    small, within 0 and the largest rate.
    """
    most = math.floor(MAX_RATE)
    pdf = pdf.sort_values(["size", "unit"], ascending=[False, True], kind="stable")
    rates, sizes, rows = pdf["rate"].to_numpy(), pdf["size"].to_numpy(), pdf["n"].to_numpy()
    total = np.zeros(len(pdf), dtype=np.int64)
    carry = 0.0
    for i, (rate, size, n) in enumerate(zip(rates, sizes, rows)):
        low = math.floor(rate + 1e-9)
        total[i] = low * n
        if size and rate - low > 1e-9:
            total[i] = min(max(math.floor(n * rate + carry / size + 0.5), low * n), (low + 1) * n)
            carry += (n * rate - total[i]) * size
    for i, (size, n) in enumerate(zip(sizes, rows)):
        step = round(carry / size) if size and abs(carry) >= size / 2 else 0
        step = min(max(step, -n, -total[i]), n, most * n - total[i])
        total[i] += step
        carry -= step * size
    return pdf.assign(total=total)


def _rounded(docs: DataFrame, weights, share: float, max_rate: float) -> DataFrame:
    """The units: doc_id, source, size, source_size, target, rate, n (equal rows), total (their copies)."""
    rows = sizes(docs)
    solved = store(multipliers(rows, targets(rows, weights, share, max_rate), max_rate), "mix-solved")
    units = (rates(rows, solved, max_rate)
             .groupBy("doc_id", "source", "key", "size", "source_size", "n_docs", "target", "rate")
             .agg(F.count(F.lit(1)).alias("n"))
             .withColumn("unit", text_key("doc_id"))
             .withColumn("salt", F.pmod(F.xxhash64("unit", "size"),
                                        F.ceil(F.col("n_docs") / GROUP).cast("long"))))
    schema = T.StructType([*units.schema.fields, T.StructField("total", T.LongType())])
    return store(units.groupBy("key", "salt").applyInPandas(round_group, schema)
                 .select("doc_id", "source", "size", "source_size", "target", "rate", "n", "total"), "mix-units")


def _copies(place: str, total: str = "total", n: str = "n") -> Column:
    """Copies of the unit's row of this place: even shares, the first rows one more."""
    return F.floor(F.col(total) / F.col(n)) + (F.col(place) < F.col(total) % F.col(n)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken: one row per document row."""
    units = _rounded(docs, weights, share, max_rate)
    # a unit of many rows is dealt out in pieces
    pieces = units.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))).alias("start"))
    rows = pieces.repartition("doc_id", "size", "start").select(
        "*", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + PIECE, F.col("n")) - 1)).alias("place"))
    return rows.withColumn("copies", _copies("place")).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """The mixed documents: every row as often as its copies say, all columns kept."""
    names = docs.columns
    unit = doc, source, size = fresh(docs, "_doc", "_source", "_size")
    n, total, part, place, inside, copies = fresh(docs, "n", "total", "_part", "_place", "_inside", "_copies")
    units = _rounded(docs, weights, share, max_rate).filter("total > 0").select(
        text_key("doc_id").alias(doc), text_key("source").alias(source), F.col("size").alias(size),
        F.col("n").alias(n), F.col("total").alias(total))
    keyed = docs.withColumns({doc: text_key("doc_id"), source: text_key("source"), size: word_count("text")}).join(units, unit)
    share_of = F.floor(F.col(total) / F.col(n)) + (F.col(place) < F.col(total) % F.col(n)).cast("long")
    single = keyed.filter(F.col(n) == 1).withColumn(copies, F.col(total))
    if not units.filter(F.col(n) > 1).isEmpty():
        # equal rows are numbered by the file part they are stored in, so a unit is never in one task
        many = store(keyed.filter(F.col(n) > 1).withColumn(part, F.spark_partition_id()), "mix-repeated", "zstd")
        earlier = Window.partitionBy(*unit).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        before = (many.groupBy(*unit, part).agg(F.count(F.lit(1)).alias(inside))
                  .withColumn(place, F.coalesce(F.sum(inside).over(earlier), F.lit(0))).drop(inside))
        here = Window.partitionBy(*unit, part).orderBy(inside)
        numbered = (many.withColumn(inside, F.expr("_metadata.row_index")).withColumn(inside, F.row_number().over(here) - 1)
                    .join(before, [*unit, part]).withColumn(place, F.col(place) + F.col(inside)))
        single = single.select(*names, copies).unionByName(numbered.withColumn(copies, _copies(place, total, n)).select(*names, copies))
    return (single.filter(F.col(copies) > 0)
            .select(*names, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copies)).select(*names))
