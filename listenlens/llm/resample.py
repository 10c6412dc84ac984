"""Resampling documents towards a target distribution, ranked by a distributed radix sort.

Texts are bags of hashed word runs (one and two words).  Counts of every bucket over
all documents and over all target texts give an array of integer log ratios, one
gain a bucket; a document's weight is the mean gain of its features.  Adding Gumbel
noise drawn from the id's hash and keeping the highest scores draws without
replacement in proportion to exp(weight / 1000).

The ranking is a least-significant-digit radix sort.  The composite key is
(not eligible, no id; score downwards; doc_id; n_features), as unsigned words cut into
16-bit digits; digits that are the same in every row need no pass.  A pass is a
stable counting sort: rows lie in blocks of consecutive positions, counts of every
(block, digit) become global prefix offsets, and each block sends its rows to their
destinations.  The last destinations are the ranks.  A block is bounded, so no task
holds more than one, whatever the keys.

Defined cases: a null text has no words, so it has no features, weight 0 and is not
drawn; a null id counts as the empty text in the hash and ranks after all others of
its score; rows of one id and score rank by their features, and beyond that are
alike; an empty table gives an empty result, an empty target leaves gains from the
smoothing alone; other columns are ignored by ``importance`` and kept by ``draw``.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlens.llm import vectext as V
from listenlens.llm.common import fresh, running_start, store

BUCKETS = 10_000
SEED = 7
# per cent of the documents with at least MIN_WORDS words that are drawn
PERCENT = 25
MIN_WORDS = 20
SCALE = 1000
DIGIT_BITS = 16
# most rows of a block; smaller tables have a block for each shuffle partition
BLOCK_ROWS = 1 << 20
_LONG_WORD = 64


def _crc_table() -> np.ndarray:
    """The 256 remainders of the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1)).astype(np.uint32)
    return t


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def _crc_step(state: np.ndarray, byte) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def crc_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of every span, from the given registers."""
    length = ends - starts
    out = state.copy()
    order = np.argsort(-length, kind="stable")
    falling = -length[order]
    long = int(np.searchsorted(falling, -_LONG_WORD, side="left"))
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(out[i] ^ _ONES)) ^ 0xFFFFFFFF
    order, falling = order[long:], falling[long:]
    s, at = out[order], starts[order]
    for j in range(int(-falling[0]) if len(falling) else 0):
        k = int(np.searchsorted(falling, -j, side="left"))
        s[:k] = _crc_step(s[:k], data[at[:k] + j])
    out[order] = s
    return out


def buckets(texts, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of one-word features, of two-word features, word offsets of the rows)."""
    data, off = V.buffers(texts)
    low = V.LOWER[data]
    starts, ends, word_off = V.spans(low, off, V.ALNUM)
    one = crc_spans(low, starts, ends, np.full(len(starts), _ONES, dtype=np.uint32))
    # a pair goes on from its first word's register, over a space and the second word
    first = np.ones(len(starts), dtype=bool)
    first[word_off[1:][np.diff(word_off) > 0] - 1] = False
    left = np.flatnonzero(first)
    two = crc_spans(low, starts[left + 1], ends[left + 1], _crc_step(one[left], np.uint32(0x20)))
    return (one ^ _ONES) % np.uint32(n_buckets), (two ^ _ONES) % np.uint32(n_buckets), word_off


def bucket_counts(texts: DataFrame, n_buckets: int = BUCKETS) -> dict[int, int]:
    """Features in every bucket over all rows; one row a task and bucket is shuffled."""
    def run(batches):
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in V.slices(batches, "text"):
            for b in buckets(batch.column("text"), n_buckets)[:2]:
                total += np.bincount(b, minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    rows = (texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    return {r.bucket: r.n for r in rows}


def gains(docs: dict[int, int], target: dict[int, int], n_buckets: int = BUCKETS) -> np.ndarray:
    """The integer log ratio of every bucket, smoothed by one count."""
    s_all, t_all = float(sum(docs.values()) + n_buckets), float(sum(target.values()) + n_buckets)
    return np.array([math.floor(SCALE * math.log((target.get(b, 0) + 1.0) * s_all / ((docs.get(b, 0) + 1.0) * t_all)))
                     for b in range(n_buckets)], dtype=np.int64)


def importance(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, seed: int = SEED,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """row (a number of its own), doc_id, n_words, n_features, weight, score; stored.

    ``keep`` names columns of docs that go along.
    """
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, n_buckets), bucket_counts(target, n_buckets), n_buckets))
    found = ["n_words", "n_features", "weight"]

    def run(batches):
        for batch in V.slices(batches, "text"):
            one, two, off = buckets(batch.column("text"), n_buckets)
            words = np.diff(off)
            pairs = np.maximum(words - 1, 0)
            total = (V.segment_sums(gain.value[one], off)
                     + V.segment_sums(gain.value[two], np.concatenate([[0], np.cumsum(pairs)])))
            n = words + pairs
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["doc_id", *names]), *(pa.array(x, pa.int64()) for x in (words, n, weight))],
                                             names=["doc_id", *names, *found])

    names = [f"_{i}" for i in range(len(keep))]
    d = docs.select("doc_id", *(F.col(c).alias(x) for c, x in zip(keep, names)), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(d.schema[c] for c in ["doc_id", *names]), *(T.StructField(c, T.LongType()) for c in found)])
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = d.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise)
    return _placed(scored, "resample-scored").withColumnRenamed("place", "row")


def _placed(df: DataFrame, name: str) -> DataFrame:
    """Stored rows with ``place``: consecutive numbers from 0 in the order of the files."""
    kept = store(df.withColumn("part", F.spark_partition_id()), name)
    parts = running_start(kept.groupBy("part").agg(F.count(F.lit(1)).alias("size")), "part", "size", "before")
    return (kept.withColumn("inside", F.expr("_metadata.row_index")).join(parts.select("part", "before"), "part")
            .withColumn("place", F.col("before") + F.col("inside")).drop("part", "before", "inside"))


def _pass(rows: DataFrame, word: str, shift: int, block_rows: int, words: list[str]) -> DataFrame:
    """One stable counting sort by a digit of ``word``: rows with their new place."""
    digits = 1 << DIGIT_BITS
    block = F.floor(F.col("place") / block_rows).cast("long")
    digit = F.shiftrightunsigned(word, shift).bitwiseAND(F.lit(digits - 1)).cast("int")
    counts = rows.groupBy(block.alias("block"), digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    # all smaller digits come before, then the same digit in earlier blocks
    smaller = running_start(counts.groupBy("digit").agg(F.sum("n").alias("n")), "digit", "n", "smaller")
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
               .join(smaller.select("digit", "smaller"), "digit")
               .select("block", "digit", (F.col("smaller") + F.col("earlier")).alias("offset")))

    def scatter(key, left, right):
        place = left.column("place").to_numpy() - key[0].as_py() * block_rows
        order = np.empty(len(place), dtype=np.int64)
        order[place] = np.arange(len(place))
        d = (left.column(word).to_numpy().view(np.uint64)[order] >> np.uint64(shift)).astype(np.uint16)
        start = np.zeros(digits, dtype=np.int64)
        start[right.column("digit").to_numpy()] = right.column("offset").to_numpy()
        by_digit = np.argsort(d, kind="stable")
        count = np.bincount(d, minlength=digits)
        inside = np.arange(len(d)) - (np.cumsum(count) - count)[d[by_digit]]
        to = np.empty(len(d), dtype=np.int64)
        to[order[by_digit]] = start[d[by_digit]] + inside
        return left.select(["row", *words]).append_column("place", pa.array(to, pa.int64()))

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ["row", *words, "place"]])
    blocks = rows.select("row", *words, "place", block.alias("block")).groupBy("block")
    return blocks.cogroup(offsets.groupBy("block")).applyInArrow(scatter, schema)


def radix_sorted(rows: DataFrame, words: list[str], block_rows: int | None = None) -> DataFrame:
    """row and place (from 0) of rows sorted by ``words``, unsigned longs, the first counting most.

    ``row`` is a number of its own for every row.  Equal keys keep an arbitrary order.
    """
    spark = rows.sparkSession
    rows = store(_placed(rows.select("row", *words), "radix-rows"), "radix-0")
    span = rows.agg(F.count(F.lit(1)).alias("n"), *(f(w).alias(f"{k}{i}") for i, w in enumerate(words)
                                                     for k, f in (("all", F.bit_and), ("any", F.bit_or)))).first()
    if not span.n:
        return rows.select("row", "place")
    block_rows = block_rows or min(BLOCK_ROWS, math.ceil(span.n / int(spark.conf.get("spark.sql.shuffle.partitions"))))
    done = 0
    for i in reversed(range(len(words))):
        differ = (span[f"all{i}"] ^ span[f"any{i}"]) & 0xFFFFFFFFFFFFFFFF
        for shift in range(0, 64, DIGIT_BITS):
            if (differ >> shift) & ((1 << DIGIT_BITS) - 1):
                done += 1
                rows = store(_pass(rows, words[i], shift, block_rows, words), f"radix-{done}")
    return rows.select("row", "place")


def ranks(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, block_rows: int | None = None) -> DataFrame:
    """The rows of ``importance`` with rank: 1, 2, 3... for those drawn, null for others."""
    fit = F.col("n_words") >= min_words
    top = scored.agg(F.max("score").alias("score"), F.count_if(fit).alias("n")).first()
    drawn = top.n * percent // 100
    doc = F.col("doc_id").cast("long")
    # a missing id ranks after the others of its score, so its flag stands below the score
    words = scored.select(
        "row", (~fit).cast("long").alias("unfit"), (F.lit(top.score) - F.col("score")).cast("long").alias("fall"),
        doc.isNull().cast("long").alias("no_id"), F.coalesce(doc.bitwiseXOR(F.lit(-1 << 63)), F.lit(0)).cast("long").alias("id"),
        F.col("n_features").alias("features"))
    place = radix_sorted(words, ["unfit", "fall", "no_id", "id", "features"], block_rows)
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return scored.join(place, "row").withColumn("rank", rank.cast("long")).drop("place")


def select(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
           n_buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    return (ranks(importance(docs, target, n_buckets, seed), percent, min_words)
            .select("doc_id", "n_features", "weight", "score", "rank"))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
         n_buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn documents, all their columns kept, with their rank (its name made fresh if taken)."""
    rank, = fresh(docs, "rank")
    scored = importance(docs, target, n_buckets, seed, keep=tuple(docs.columns))
    return (ranks(scored, percent, min_words).filter("rank is not null")
            .select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)), F.col("rank").alias(rank)))
