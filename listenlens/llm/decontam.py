"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to words and cut into windows of ``window`` words (an
item of fewer words, but not none, is one window).  All windows go into one
automaton over the text; every document is normalised the same way and scanned
once, and match ends are mapped back to word numbers and to code points of the
original text.

Defined cases: null and empty texts have no words, so they are clean; items
without a word are ignored; items with a null id count as one item, whose hits count
like any other's, but which has no part in the digest of the ids; repeated rows are
each judged; empty tables give no hits; other columns are ignored.  The automaton is
sent to every task, so the items' words are counted first: beyond ``max_words`` the
items are dealt to several automata, an item of its own too many words in pieces that
share all windows, and the texts are scanned by one after the other.
"""

from __future__ import annotations

import math
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlens.llm import vectext as V
from listenlens.llm.common import store

WINDOW = 10
MAX_WORDS = 20_000_000

# lower-cases A-Z; every other ASCII byte that is no digit or letter becomes a space
_NORMAL = bytes(V.LOWER[b] if V.ALNUM[b] else 0x20 for b in range(256))
_WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BUILT: dict[str, ahocorasick.Automaton] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def _joined(ws: list[bytes]) -> str:
    return (b" " + b" ".join(ws) + b" ").decode("utf-8", "surrogatepass")


def build(items: list[tuple[str, str]], window: int) -> ahocorasick.Automaton:
    """Automaton of all windows; the value is (words in the window, item numbers)."""
    seen: dict[str, tuple[int, list[int]]] = {}
    for i, (_, text) in enumerate(items):
        ws = normal_words(text)
        n = min(window, len(ws))
        for j in range(len(ws) - n + 1 if n else 0):
            found = seen.setdefault(_joined(ws[j:j + n]), (n, []))[1]
            if not found or found[-1] != i:
                found.append(i)
    auto = ahocorasick.Automaton()
    for key, value in seen.items():
        auto.add_word(key, value)
    if seen:
        auto.make_automaton()
    return auto


def scan(auto, text: str | None):
    """(words, hit flags or None, item numbers) of one text."""
    ws = normal_words(text)
    if not ws or not len(auto):
        return ws, None, []
    found = list(auto.iter(_joined(ws)))
    if not found:
        return ws, None, []
    # every match ends on the blank after its last word
    blanks = np.cumsum([len(w.decode("utf-8", "surrogatepass")) + 1 for w in ws])
    last = np.searchsorted(blanks, [e for e, _ in found])
    edge = np.zeros(len(ws) + 1, dtype=np.int64)
    size = np.array([v[0] for _, v in found])
    np.add.at(edge, last - size + 1, 1)
    np.add.at(edge, last + 1, -1)
    return ws, np.cumsum(edge[:-1]) > 0, sorted({i for _, v in found for i in v[1]})


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code point spans of the original text."""
    arr = pa.array([text], pa.string())
    data, off = V.buffers(arr)
    starts, ends, _ = V.spans(data, off, V.ALNUM)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])}
            for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]


def _ranges(benchmark: DataFrame, window: int, max_words: int) -> list[DataFrame]:
    """The distinct items, counted and dealt to ranges of at most about max_words words."""
    items = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
             .filter("text is not null").distinct().withColumn("size", F.regexp_count("text", F.lit(_WORD_PATTERN))))
    size = items.agg(F.sum("size")).first()[0] or 0
    if size <= max_words:
        return [items.drop("size")]
    # pieces of a long item overlap by a window less one word, so every window is in one
    step = max(1, max_words // 8)
    words = F.regexp_extract_all("text", F.lit(_WORD_PATTERN), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.col("size") - (window - 1), F.lit(1)), F.lit(step))
    pieces = items.filter(F.col("size") > step).select("item_id", F.explode(F.transform(
        starts, lambda at: F.array_join(F.slice(words, at, step + window - 1), " "))).alias("text"))
    items = store(items.filter(F.col("size") <= step).select("item_id", "text").unionByName(pieces), "benchmark-items")
    n = math.ceil(2 * size / max_words)
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _shared(spark, items: DataFrame):
    """The items of one range, sent to every task; their size was counted."""
    found = sorted(((r.item_id, r.text) for r in items.collect()), key=lambda x: (x[0] is None, x))
    return uuid.uuid4().hex, spark.sparkContext.broadcast(found)


def _automaton(key: str, shared, window: int):
    """The worker's automaton, built once for each broadcast."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build(shared.value, window)
    return _BUILT[key]


_RUN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_RUN_TYPE = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _scanned(docs: DataFrame, key, shared, window: int, last: bool) -> DataFrame:
    """Adds one automaton's findings: n_words, runs of hit words, ids of the items found; at last spans, without the text."""
    def run(batches):
        auto = _automaton(key, shared, window)
        for batch in batches:
            n_words, runs, ids, spans = [], [], [], []
            texts = batch.column("text").to_pylist()
            for text, old, seen in zip(texts, batch.column("runs").to_pylist(), batch.column("item_ids").to_pylist()):
                ws, hit, found = scan(auto, text)
                flags = np.zeros(len(ws) + 1, dtype=np.int8)
                if hit is not None:
                    flags[:-1] |= hit
                for r in old:
                    flags[r["first"]:r["last"]] = 1
                step = np.diff(np.concatenate([[0], flags]))
                n_words.append(len(ws))
                runs.append([{"first": int(a), "last": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))])
                ids.append(sorted({*seen, *(shared.value[i][0] for i in found)}, key=lambda x: (x is None, x or "")))
                if last:
                    spans.append(original_spans(text, flags[:-1].astype(bool)) if runs[-1] else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, _SPANS) if last else batch.column("text"), pa.array(n_words, pa.int64()),
                 pa.array(runs, _RUN), pa.array(ids, pa.list_(pa.string()))],
                names=["doc_id", "spans" if last else "text", "n_words", "runs", "item_ids"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("spans", _SPANS_TYPE) if last else docs.schema["text"],
                           T.StructField("n_words", T.LongType()), T.StructField("runs", _RUN_TYPE),
                           T.StructField("item_ids", T.ArrayType(T.StringType()))])
    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted, a missing id last), spans of hit words in the original text."""
    none = F.array().cast(_RUN_TYPE)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
                        none.alias("runs"), F.array().cast("array<string>").alias("item_ids"))
    ranges = _ranges(benchmark, window, max_words)
    for i, items in enumerate(ranges):
        last = i == len(ranges) - 1
        found = _scanned(found, *_shared(docs.sparkSession, items), window, last)
        if not last:
            # one automaton in a worker at a time
            found = store(found, "benchmark-scanned", "zstd")
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "item_ids", "spans")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_compact("item_ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
          max_words: int = MAX_WORDS) -> DataFrame:
    """The documents without a hit word, all columns kept.

    The scan reads the text where it stands, so no join is needed to filter.
    """
    def cleaned(rows: DataFrame, key, shared) -> DataFrame:
        def run(batches):
            auto = _automaton(key, shared, window)
            for batch in batches:
                keep = [scan(auto, t)[1] is None for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    ranges = _ranges(benchmark, window, max_words)
    for i, items in enumerate(ranges):
        docs = cleaned(docs, *_shared(docs.sparkSession, items))
        if i < len(ranges) - 1:
            docs = store(docs, "benchmark-clean", "zstd")
    return docs
