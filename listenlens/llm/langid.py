"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled texts.  A
text is lower-cased, cut into chunks (so that the dictionary, not the text's own
earlier part, is what matches), and coded whole with every dictionary; the
language whose dictionary gives the fewest bytes wins.  The score is the
relative margin to the second language; a narrow margin is rejected.

The classifier is fitted on a bounded sample of labelled rows: at most
``sample_texts`` distinct texts of each language, chosen by text hash, with
``excerpt`` characters each, up to ``dictionary_bytes``.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
equal sizes go to the language with more training texts, then by name; with one
language the score is 1; without any labelled row everything is ``und``;
repeated rows are each judged; other columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlens.llm import vectext as V
from listenlens.llm.common import crc_mod

SAMPLE_TEXTS = 512
BUCKETS = 64
EXCERPT = 2000
DICTIONARY_BYTES = 128 * 1024
LEVEL = 6
CHUNK = 1024
MIN_MARGIN = 0.005
UNKNOWN = "und"

_CODERS: dict[str, list] = {}


def held_out() -> Column:
    """Documents kept from training: crc32 of the id as text, modulo 4, is 2."""
    return crc_mod("doc_id", 4) == 2


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, excerpt: int = EXCERPT,
          dictionary_bytes: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary), languages with more training texts first."""
    train = (docs.select("doc_id", F.col("lang").cast("string").alias("lang"),
                         F.col("text").cast("string").alias("text"))
             .filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
             .select("lang", "text", F.xxhash64("text").alias("h")))
    by_text = train.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
    # the same number of texts from each hash bucket, so no task ranks a whole language
    w = Window.partitionBy("lang", F.pmod("h", F.lit(BUCKETS))).orderBy("h")
    chosen = (by_text.withColumn("rank", F.row_number().over(w))
              .filter(F.col("rank") <= max(1, sample_texts // BUCKETS)))
    # sample_texts rows a language: small whatever the input
    sample = (train.select("lang", "h", F.substring("text", 1, excerpt).alias("text"))
              .join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"])
              .groupBy("lang", "h").agg(F.min("text").alias("text")))
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts: dict[str, list[bytes]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.lang, r.h)):
        texts.setdefault(r.lang, []).append(r.text.lower().encode("utf-8", "surrogatepass"))
    return [(lang, b"\n".join(texts[lang])[:dictionary_bytes])
            for lang in sorted(texts, key=lambda x: (-sizes[x], x))]


def coders(model: list[tuple[str, bytes]]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, raw in model:
        # 8 bytes is the shortest content a dictionary takes
        d = zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False,
                                                   write_content_size=False, write_dict_id=False)))
    return out


def classify(data, tools) -> tuple[str, float]:
    """(language, relative margin) of one lower-cased text as bytes."""
    parts = [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]
    sizes = [sum(len(c.compress(p)) for p in parts) for _, c in tools]
    if not sizes:
        return UNKNOWN, 0.0
    best = min(range(len(sizes)), key=sizes.__getitem__)
    if len(sizes) == 1:
        return tools[0][0], 1.0
    second = min(s for i, s in enumerate(sizes) if i != best)
    return tools[best][0], (second - sizes[best]) / second


def _judge(arr, tools) -> tuple[list[str], list[float]]:
    lower = pc.utf8_lower(pc.fill_null(arr, ""))
    letters = pc.match_substring_regex(lower, r"\p{L}").to_pylist()
    data, off = V.buffers(lower)
    view = memoryview(data)
    found = [classify(view[off[i]:off[i + 1]], tools) if has else (UNKNOWN, 0.0)
             for i, has in enumerate(letters)]
    return [f[0] for f in found], [f[1] for f in found]


def _share(docs: DataFrame, model):
    """A key and the broadcast model: one dictionary a language."""
    model = learn(docs) if model is None else model
    return uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)


def _tools(key: str, shared):
    """The worker's coders, built once for each broadcast."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = coders(shared.value)
    return _CODERS[key]


def identify(docs: DataFrame, model: list[tuple[str, bytes]] | None = None,
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per document row."""
    key, shared = _share(docs, model)

    def run(batches):
        tools = _tools(key, shared)
        for batch in batches:
            lang, score = _judge(batch.column("text"), tools)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()),
                 pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([d.schema["doc_id"], d.schema["held_out"],
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return d.mapInArrow(run, schema).withColumn(
        "rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_margin))


def keep_identified(docs: DataFrame, model: list[tuple[str, bytes]] | None = None,
                    min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose language is clear, with all their columns."""
    key, shared = _share(docs, model)

    def run(batches):
        tools = _tools(key, shared)
        for batch in batches:
            lang, score = _judge(batch.column("text"), tools)
            yield batch.filter(pa.array([a != UNKNOWN and b >= min_margin for a, b in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
