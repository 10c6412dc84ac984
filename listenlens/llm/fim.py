"""Fill-in-the-middle documents, cut by code points with a sparse exception index.

A text is cut into prefix, middle and suffix at code points drawn from the hash
of its id, and written as prefix-suffix-middle (psm), suffix-prefix-middle (spm)
or plain.  The bytes of a batch of texts are one buffer.  The index holds only its
characters of more than one byte: their code point positions and the running
sum of their excess bytes.  A code point cut becomes a byte cut by one
``searchsorted`` in that index; between two exceptions the step is arithmetic, so
ASCII text has no entries at all.

Defined cases: a null text counts as empty, and an empty text is plain; a text that
holds a mark is plain, so marks in an output are always the operator's own; a null
id is hashed as the empty text; repeated rows are each transformed alike; an empty
table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlens.llm import vectext as V
from listenlens.llm.common import fresh

SEED = 1
# per cent of the texts that are transformed, and of these the per cent in spm order
RATE = 90
SPM = 20
MARKS = ("<P>", "<S>", "<M>")


class ExceptionIndex:
    """Characters of more than one byte in a UTF-8 buffer, and nothing else."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        first = data[lead]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        #: byte positions, code point positions, and excess bytes of all earlier entries
        self.lead = lead
        self.before = np.concatenate([[0], np.cumsum(excess)])
        self.point = lead - self.before[:-1]

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """Code points before byte offsets that are character starts or ends."""
        return at - self.before[np.searchsorted(self.lead, at, side="left")]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Byte offsets of code point positions."""
        return at + self.before[np.searchsorted(self.point, at, side="left")]


def _check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they stand: none holds, or overlaps, another."""
    if len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks are needed")
    for a, b in combinations_with_replacement(marks, 2):
        if a != b and (a in b or b in a):
            raise ValueError(f"mark {a!r} and mark {b!r} hold one another")
        for x, y in ((a, b), (b, a)):
            if any(x.endswith(y[:k]) for k in range(1, min(len(x), len(y)))):
                raise ValueError(f"the end of {x!r} is the start of {y!r}")


def _draws(doc_id: str, seed: int) -> list[Column]:
    """The first four 8-digit groups of the id's hash, as numbers."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _assemble(data, off, form, cut1, cut2, marks) -> list[bytes]:
    """Outputs of one batch; cuts are byte offsets in the buffer."""
    p, s, m = (x.encode() for x in marks)
    raw = memoryview(np.ascontiguousarray(data))
    out = []
    for i, kind in enumerate(form):
        a, b, c, d = off[i], cut1[i], cut2[i], off[i + 1]
        if kind == "plain":
            out.append(bytes(raw[a:d]))
        elif kind == "psm":
            out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
        else:
            out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
    return out


def transform(docs: DataFrame, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS,
              seed: int = SEED) -> DataFrame:
    """All columns of docs with n (code points), form, prefix_chars, middle_chars and output."""
    _check_marks(marks)
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in docs.columns if c.lower() not in new]
    text, h1, h2, plain, order = fresh(docs, "_text", "_h1", "_h2", "_plain", "_order")
    d1, d2, d3, d4 = _draws("doc_id", seed)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.lit(False)
    for x in marks:
        marked = marked | F.contains(body, F.lit(x))
    drawn = docs.select(*kept, body.alias(text), d1.alias(h1), d2.alias(h2),
                        ((body == "") | marked | (d3 % 100 >= rate)).alias(plain), (d4 % 100 < spm).alias(order))

    def run(batches):
        for batch in V.slices(batches, text):
            data, off = V.buffers(batch.column(text))
            index = ExceptionIndex(data)
            start = index.to_points(off)
            n = np.diff(start)
            x, y = (batch.column(c).to_numpy() % (n + 1) for c in (h1, h2))
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            is_plain = batch.column(plain).to_numpy(zero_copy_only=False)
            first = batch.column(order).to_numpy(zero_copy_only=False)
            form = np.where(is_plain, "plain", np.where(first, "spm", "psm")).tolist()
            out = _assemble(data, off, form, index.to_bytes(start[:-1] + lo), index.to_bytes(start[:-1] + hi), marks)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(lo, pa.int64(), mask=is_plain), pa.array(hi - lo, pa.int64(), mask=is_plain),
                 pa.array(out, pa.binary()).view(pa.string())], names=[*kept, *new])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n", T.LongType()),
                           T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                           T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    return drawn.mapInArrow(run, schema)


def restored(marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text again, from the columns ``output`` and ``form`` alone."""
    p, s, m = marks
    out = F.col("output")

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(out, b, 1), a, -1)

    middle = F.substring_index(out, m, -1)
    return (F.when(F.col("form") == "plain", out)
            .when(F.col("form") == "psm", F.concat(between(p, s), middle, between(s, m)))
            .otherwise(F.concat(between(p, m), middle, between(s, p))))


def digest(done: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of output and restored text."""
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(marks), 256).alias("restored_sha256"))
