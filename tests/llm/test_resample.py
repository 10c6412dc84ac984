"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listenlens.llm import resample
from listenlens.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm import frames

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    ws = WORD.findall((text or "").translate(LOWER))
    return ws, [zlib.crc32(f.encode()) % 10_000 for f in ws + [" ".join(p) for p in zip(ws, ws[1:])]]


def brute(docs, target):
    """{(doc_id, n_features, weight, score, rank)} of (doc_id, text) rows."""
    s, t = [0] * 10_000, [0] * 10_000
    rows = [(i, *features(x)) for i, x in docs]
    for _, _, fs in rows:
        for b in fs:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for i, ws, fs in rows:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in fs) // len(fs) if fs else 0
        out.append((i, len(ws), len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = fit[:25 * len(fit) // 100]
    rest = [r for r in out if r[1] < 20] + fit[len(drawn):]
    return sorted([(str(r[0]), *r[2:], k + 1) for k, r in enumerate(drawn)] + [(str(r[0]), *r[2:], 0) for r in rest])


def got(df):
    return sorted((str(r.doc_id), r.n_features, r.weight, r.score, r.rank or 0) for r in df.collect())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé東 9-_\x00"), max_size=90), max_size=6))
def test_buckets_are_crc32_of_the_features(texts):
    import pyarrow as pa
    one, two, off = resample.buckets(pa.array(texts, pa.string()), 10_000)
    want = [features(t) for t in texts]
    assert np.diff(off).tolist() == [len(ws) for ws, _ in want]
    assert one.tolist() == [b for ws, fs in want for b in fs[:len(ws)]]
    assert two.tolist() == [b for ws, fs in want for b in fs[len(ws):]]


def test_whole_table_equals_brute_force(spark):
    docs, bench = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert got(resample.select(docs, bench)) == want
    assert got(resample.select(docs.repartition(7), bench)) == want


def test_awkward_rows_and_drawn_documents(spark):
    rows = frames.edge_rows()
    docs = frames.edge_docs(spark)
    target = frames.bench(spark, [(1, "the other an"), (None, None), (2, ""), (3, frames.words(30, 9))])
    want = brute([(r[0], r[1]) for r in rows], ["the other an", "", frames.words(30, 9)])
    assert got(resample.select(docs, target)) == want
    drawn = resample.draw(docs, target)
    assert drawn.columns == [*docs.columns, "rank"]
    assert sorted(str(r.doc_id) for r in drawn.collect()) == sorted(w[0] for w in want if w[4])
    assert resample.select(frames.no_docs(spark), target).count() == 0
    assert got(resample.select(docs, frames.bench(spark, []))) == brute([(r[0], r[1]) for r in rows], [])


@pytest.mark.parametrize("block_rows", [3, 64, None])
def test_radix_sort_orders_unsigned_words(spark, block_rows):
    r = random.Random(block_rows)
    rows = [(i, r.choice([0, 1, 1]), r.choice([r.randrange(-1 << 63, 1 << 63), 5, -5, 70_000])) for i in range(300)]
    done = resample.radix_sorted(spark.createDataFrame(rows, "row long, a long, b long"), ["a", "b"], block_rows).collect()
    place = {x.row: x.place for x in done}
    assert sorted(place.values()) == list(range(300))
    keys = [(a, b % (1 << 64)) for i, a, b in sorted(rows, key=lambda x: place[x[0]])]
    assert keys == sorted(keys)


def test_one_score_for_most_rows(spark):
    # two thirds of the rows share the whole key but for the id
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit(frames.words(25, 3)).alias("text"))
    scored = (resample.importance(docs, docs.limit(0)).withColumn("score", F.when(F.col("doc_id") < 600, 7).otherwise(F.col("score") % 50).cast("long")))
    ranked = resample.ranks(scored, percent=100, block_rows=50).orderBy("rank").collect()
    assert [(-r.score, r.doc_id) for r in ranked] == sorted((-r.score, r.doc_id) for r in ranked) and ranked[-1]["rank"] == 900
