"""Rule bitmask ledger (quality rules).

``ledger`` measures every whole text once and stores, next to the measurements,
one bit per failed rule.  Policies are versioned sets of rules: applying one, or
asking what a rule alone removes, only reads the bits (``apply_policy``,
``ablation``), so a policy change never rescans text.

Defined cases: a null or empty text has no words and fails ``few_words``;
repeated rows are each measured; an empty table gives an empty ledger; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlens.llm import vectext as V

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_letters", "n_upper", "n_bangs")

# name -> condition that fails a text; the position is the bit
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "100 * n_upper > 50 * n_letters"),
    ("exclamations", "100 * n_bangs > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("few_letters", "100 * n_letters < 50 * word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(names) -> int:
    return sum(BIT[n] for n in names)


# version -> rules that remove a document; published versions never change
POLICIES = {
    "base-1": mask(["few_words", "repeated_words"]),
    "web-1": mask(["few_words", "repeated_words", "symbols", "duplicate_lines"]),
    "web-2": mask([n for n, _ in RULES]),
}
DEFAULT_POLICY = "web-2"

_SYMBOL = V.byte_table(b"#*$%&|<>")
_UPPER = V.byte_table(range(0x41, 0x5B))
_LETTER = V.byte_table([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_CONT = V.byte_table(range(0x80, 0xC0))
_HIGH = V.byte_table(range(0xC0, 0x100))


def _count(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    return V.segment_sums(table[data], off)


def repeat_words(h: np.ndarray, off: np.ndarray, k: int = 3) -> np.ndarray:
    """Per row: words inside a k-word window that occurs twice or more in the row."""
    row = V.rows_of(off)
    hit = np.zeros(len(h) + k, dtype=bool)
    if len(h) >= k:
        n = len(h) - k + 1
        w = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            w = V.mix(w * V._C1 + h[j:j + n])
        inside = np.flatnonzero(row[:n] == row[k - 1:])
        key = V.mix(w[inside] ^ V.mix(row[inside].astype(np.uint64) + V._C1))
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        first = inside[order[twice]]
        for j in range(k):
            hit[first + j] = True
    return V.segment_sums(hit[:len(h)], off)


def dup_lines(data: np.ndarray, off: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: (lines with a word, those equal to an earlier line of the row)."""
    n = len(off) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]))
    row = np.searchsorted(off, starts, side="right") - 1
    # a break at the very end of a row opens an empty line there, not in the next row
    nxt = np.append(starts[1:], len(data))
    ends = np.where(np.isin(nxt - 1, breaks, assume_unique=False) & (nxt > starts), nxt - 1, nxt)
    has_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, row = starts[has_word], ends[has_word], row[has_word]
    row = np.searchsorted(off, starts, side="right") - 1
    lines = np.bincount(row, minlength=n)
    key = V.mix(V.hash_spans(data, starts, ends, 7) ^ V.mix(row.astype(np.uint64) + V._C1))
    _, first = np.unique(key, return_index=True)
    return lines, lines - np.bincount(row[first], minlength=n)


def measure(arr: pa.Array) -> dict[str, np.ndarray]:
    h, off, starts, _, data, rows = V.words(arr, V.NON_SPACE, lower=False)
    not_cont = ~_CONT & V.NON_SPACE
    lines, dup = dup_lines(data, rows, starts)
    return {
        "n_words": np.diff(off), "word_chars": _count(data, rows, not_cont),
        "n_symbols": _count(data, rows, _SYMBOL), "n_dup_lines": dup,
        "n_repeat_words": repeat_words(h, off), "n_lines": lines,
        "n_letters": _count(data, rows, _LETTER | _HIGH), "n_upper": _count(data, rows, _UPPER),
        "n_bangs": _count(data, rows, V.byte_table(b"!")),
    }


def _measure_batches(batches):
    for part in V.slices(batches, "text"):
        m = measure(part.column("text"))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *[pa.array(m[c].astype(np.int64)) for c in MEASURES]],
            names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed_bits``, one row per document row."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([d.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in MEASURES]])
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
            for i, (_, cond) in enumerate(RULES)]
    return (d.mapInArrow(_measure_batches, schema)
            .withColumn("failed_bits", reduce(lambda a, b: a.bitwiseOR(b), bits)))


def fails(version: str):
    """Column: does the ledger row fail a rule of this policy?"""
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) != 0


def apply_policy(led: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    return led.withColumns({"base_failed": fails("base-1"), "kept": ~(fails("base-1") | fails(version))})


def ablation(led: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy: texts it fails, texts only it fails, texts kept without it.

    One aggregation by bit pattern (at most 2^rules groups), then bit arithmetic.
    """
    m = POLICIES[version]
    by = (led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits"))
          .agg(F.count(F.lit(1)).alias("n")))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit"))
                      for n, b in BIT.items() if b & m])
    return (by.select("bits", "n", F.explode(rules).alias("r"))
            .groupBy(F.lit(version).alias("policy"), F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
                 F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0))
                 .alias("n_kept_without")))


def quality(docs: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with the verdicts of a policy; base failures are never kept."""
    return apply_policy(ledger(docs), version)
