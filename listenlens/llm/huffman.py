"""Token ids as canonical, length-limited Huffman blocks.

Format: one row per block, in (part, seq) order.  ``payload`` is the bit string
of the block's ids, most significant bit first; ``marks`` holds, as uint16, the
bits used by every ``MARK`` ids, so decoding can start at any mark (all marks of
a block are decoded side by side with one lookup table).  ``doc_ids`` and
``doc_sizes`` list the documents of the block; a document is never split, so a
block holds ``BLOCK`` ids plus at most one document.  The code is canonical: the
lengths of all ids (one byte each) restore it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from listenlens.llm import vectext as V
from listenlens.llm.common import running_start, store

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
MAX_BITS = 16
MARK = 256
BLOCK = 1 << 18
# pieces remembered by a worker before it starts over (bounds its memory)
CACHE_PIECES = 2_000_000


# ---- code -------------------------------------------------------------------

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge (0: unused id)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids do not fit in codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, []
    for _ in range(max_bits):
        kinds.append(None)
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        pos = np.argsort(both, kind="stable")
        kinds[-1] = pos < n
        level = both[pos]
    # the last merge made one level too many; count down from the one before
    length = np.zeros(n, dtype=np.int64)
    need = 2 * n - 2
    chain = [np.ones(n, dtype=bool), *kinds[:-1]]
    for kind in reversed(chain):
        taken = int(kind[:need].sum())
        length[:taken] += 1
        need = 2 * (need - taken)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, last = 0, 0
    for i in order[np.searchsorted(lengths[order], 1):]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, code length) for every bit pattern of the longest code's width."""
    width = int(lengths.max()) if len(lengths) else 0
    ids = np.zeros(1 << width, dtype=np.uint32)
    bits = np.ones(1 << width, dtype=np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    run = np.left_shift(1, width - lengths[order].astype(np.int64))
    total = int(run.sum())
    ids[:total] = np.repeat(order, run)
    bits[:total] = np.repeat(lengths[order], run)
    return ids, bits, width


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, marks) of the ids."""
    if len(ids) == 0:
        return b"", b""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    word = at >> 5
    v = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).view(np.uint64)
    # bits of one word and the next, brought together for all codes that start in the word
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    both = np.bitwise_or.reduceat(v, first)
    out = np.zeros(int(word[-1]) + 2, dtype=np.uint32)
    out[word[first]] = (both >> np.uint64(32)).astype(np.uint32)
    out[word[first] + 1] |= both.astype(np.uint32)
    payload = out.astype(">u4").tobytes()[:int((end[-1] + 7) >> 3)]
    marks = np.diff(np.append(at[::MARK], end[-1])).astype("<u2").tobytes()
    return payload, marks


def unpack(payload: bytes, marks: bytes, n: int, table) -> np.ndarray:
    """The ids of a block: all marked runs are decoded side by side."""
    if n == 0:
        return np.zeros(0, dtype=np.uint32)
    ids, bits, width = table
    raw = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8)
    word = np.zeros(len(raw) - 3, dtype=np.uint32)
    for k in range(4):
        word |= raw[k:len(raw) - 3 + k].astype(np.uint32) << np.uint32(24 - 8 * k)
    size = np.frombuffer(marks, dtype="<u2").astype(np.int64)
    pos = np.cumsum(size) - size
    out = np.zeros((MARK, len(size)), dtype=np.uint32)
    mask = np.uint32((1 << width) - 1)
    for step in range(MARK):
        live = len(size) if step < (n - 1) % MARK + 1 else len(size) - 1
        if live == 0:
            break
        p = pos[:live]
        c = (word[p >> 3] >> (32 - width - (p & 7)).astype(np.uint32)) & mask
        out[step, :live] = ids[c]
        pos[:live] = p + bits[c]
    return out.T.reshape(-1)[:n]


# ---- tokenizer --------------------------------------------------------------

# white space beside blank and line break, or bytes that may begin it in UTF-8
_OTHER_SPACE = V.byte_table([9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F])
_MAYBE_SPACE = {(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)}
_NOT_BETWEEN = V.byte_table(b for b in range(256) if b not in (0x20, 0x0A))
_AFTER_BLANK = np.uint64(0xA5A5A5A5A5A5A5A5)


class Pieces:
    """Ids of text pieces by piece hash: sorted hashes, places in a pool of ids.

    Misses are coded together as one text; ``opens`` tells, by id, where the next
    piece starts (``drop``: the id there is not the piece's own).
    """

    def __init__(self, tokenizer: Tokenizer, between: bytes, opens: np.ndarray, drop: int):
        self.tokenizer, self.between, self.opens, self.drop = tokenizer, between, opens, drop
        self.clear()

    def clear(self) -> None:
        self.h, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def places(self, h: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, ids) of distinct hashes; ``word(i)`` gives the bytes of the i-th."""
        if len(self.h) > CACHE_PIECES:
            self.clear()
        miss = np.flatnonzero(~self._known(h)[1])
        if len(miss):
            self._learn(h[miss], [word(i) for i in miss.tolist()])
        at, _ = self._known(h)
        return self.at[at], self.n[at]

    def _known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        return at, (self.h[at] == h if len(self.h) else np.zeros(len(h), dtype=bool))

    def _learn(self, h: np.ndarray, new: list[bytes]) -> None:
        ids = []
        for i in range(0, len(new), 8192):
            text = (self.between + self.between.join(new[i:i + 8192])).decode("utf-8", "surrogatepass")
            ids += self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.array(ids, dtype=np.uint32)
        cut = np.flatnonzero(self.opens[ids])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        n = np.diff(np.append(cut, len(ids))) - self.drop
        merged = np.concatenate([self.h, h])
        order = np.argsort(merged, kind="stable")
        self.h = merged[order]
        self.at = np.concatenate([self.at, (self.used + cut + self.drop).astype(np.int32)])[order]
        self.n = np.concatenate([self.n, n.astype(np.int32)])[order]
        self.used += len(ids)


class Coder:
    """Texts to ids by their pieces.

    The vocabulary's splitter always starts a new piece at a blank that is
    followed by a non-blank, and around a lone line break, so a text's ids are
    those of its pieces in turn.  Texts with other white space, or some side by
    side, or with a special token's name go to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_break, = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # the byte-level alphabet's sign for a blank, which pieces have in front only
        blank = self.tokenizer.id_to_token(self.tokenizer.encode(" ", add_special_tokens=False).ids[0])
        opens = np.zeros((2, self.tokenizer.get_vocab_size()), dtype=bool)
        opens[0, self.line_break] = True
        opens[1, [i for t, i in self.tokenizer.get_vocab().items() if t.startswith(blank)]] = True
        self.head, self.tail = Pieces(self.tokenizer, b"\n", opens[0], 1), Pieces(self.tokenizer, b" ", opens[1], 0)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, arr, end: int = END_ID) -> list[np.ndarray]:
        """Ids of every text of a string column, closed by the end id."""
        data, off = V.buffers(arr)
        starts, ends, word_off = V.spans(data, off, _NOT_BETWEEN)
        n_words = np.diff(word_off)
        odd = (np.diff(off) > 0) & (V.segment_sums(~_NOT_BETWEEN[data], off) != n_words - 1)
        odd |= V.segment_sums(_OTHER_SPACE[data], off) > 0
        raw = data.tobytes()
        for name in self.special:
            at = raw.find(name)
            while at >= 0:
                odd[np.searchsorted(off, at, side="right") - 1] = True
                at = raw.find(name, at + 1)
        if len(data) > 1:
            for a, b in _MAYBE_SPACE:
                at = np.flatnonzero((data[:-1] == a) & (data[1:] == b))
                odd[np.searchsorted(off, at, side="right") - 1] = True

        row = V.rows_of(word_off)
        use = ~odd[row]
        starts, ends, row = starts[use], ends[use], row[use]
        first = np.ones(len(row), dtype=bool)
        first[1:] = row[1:] != row[:-1]
        tail = ~first & (data[starts - 1] == 0x20)
        h = V.hash_spans(data, starts, ends, 3) ^ np.where(tail, _AFTER_BLANK, np.uint64(0))
        u, one, back = np.unique(h, return_index=True, return_inverse=True)
        is_tail = tail[one]
        view = memoryview(data.tobytes())
        at, n = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        for pieces, mine in ((self.head, np.flatnonzero(~is_tail)), (self.tail, np.flatnonzero(is_tail))):
            s, e = starts[one[mine]].tolist(), ends[one[mine]].tolist()
            at[mine], n[mine] = pieces.places(u[mine], lambda i, s=s, e=e: bytes(view[s[i]:e[i]]))
        # a line break's id stands before every piece that opens a later line
        n_word, breaks = n[back], (~first & ~tail).astype(np.int64)
        size = n_word + breaks
        per_row = np.bincount(row, weights=size, minlength=len(odd)).astype(np.int64) + 1
        per_row[odd] = 0
        row_at = np.concatenate([[0], np.cumsum(per_row)])
        # places of a row's words: those of the words before, and the end ids of the rows before
        word_at = np.cumsum(size) - size
        inside = word_at - np.concatenate([[0], word_at])[1:][np.searchsorted(row, row)] if len(row) else word_at
        place = row_at[row] + inside + breaks
        out = np.full(row_at[-1], self.line_break, dtype="<u4")
        for pieces, mine in ((self.head, ~tail), (self.tail, tail)):
            k = n_word[mine]
            ramp = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            out[np.repeat(place[mine], k) + ramp] = pieces.pool[np.repeat(at[back[mine]], k) + ramp]
        out[row_at[1:][~odd] - 1] = end
        got = [out[a:b] for a, b in zip(row_at[:-1].tolist(), row_at[1:].tolist())]
        for i in np.flatnonzero(odd).tolist():
            got[i] = np.append(self.whole(bytes(view[off[i]:off[i + 1]]).decode("utf-8", "surrogatepass")), np.uint32(end)).astype("<u4")
        return got


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


# ---- Spark ------------------------------------------------------------------

def tokenize(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, part, n_tokens, ids: documents in ascending id order, stored.

    The texts are range-partitioned first, so the ids are written once, in
    order; rows with equal ids are ordered by a hash of their text, null ids come first.
    """
    def run(batches):
        code = coder(public_tokenizers.path(tokenizer))
        kind = "<u2" if code.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for part in V.slices(batches, "text"):
            ids = code.encode(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("part"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())],
                names=["doc_id", "part", "n_tokens", "ids"])

    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    in_order = (d.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
                .sortWithinPartitions("doc_id", "tie", "text")
                .withColumn("part", F.spark_partition_id()))
    schema = T.StructType([d.schema["doc_id"], T.StructField("part", T.IntegerType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return store(in_order.mapInArrow(run, schema), "token-ids", "zstd")


def _ids(value: bytes, n: int) -> np.ndarray:
    return np.frombuffer(value, dtype="<u2" if len(value) == 2 * n else "<u4")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """Global count of every id; the vocabulary bounds what reaches the driver."""
    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for part in V.slices(batches, "ids"):
            raw, _ = V.buffers(part.column("ids"))
            c = np.bincount(_ids(raw.tobytes(), int(part.column("n_tokens").to_numpy().sum())))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), dtype=np.int64)])
            total[:len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = (tokens.select("n_tokens", "ids").mapInArrow(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, dtype=np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def encode_blocks(tokens: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Blocks of whole documents; ``seq`` is the first document's place in its part."""
    sc = tokens.sparkSession.sparkContext
    code = sc.broadcast((lengths, canonical(lengths)))

    def run(batches):
        size, codes = code.value
        held: list = []
        part, count = None, 0

        def block():
            ids = np.concatenate([x[2] for x in held])
            payload, marks = pack(ids, size, codes)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([held[0][3]], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([[x[0] for x in held]], pa.list_(kind)), pa.array([[x[1] for x in held]], pa.list_(pa.int64())),
                 pa.array([marks], pa.binary()), pa.array([payload], pa.binary())],
                names=["part", "seq", "n_ids", "doc_ids", "doc_sizes", "marks", "payload"])

        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            for doc, p, n, v, s in zip(batch.column("doc_id"), batch.column("part").to_pylist(),
                                       batch.column("n_tokens").to_pylist(), batch.column("ids"),
                                       batch.column("seq").to_pylist()):
                if held and (p != part or count >= BLOCK or s != held[-1][3] + 1):
                    yield block()
                    held, count = [], 0
                part, count = p, count + n
                held.append((doc.as_py(), n, _ids(v.as_buffer(), n), s))
        if held:
            yield block()

    doc = tokens.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(doc)), T.StructField("doc_sizes", T.ArrayType(T.LongType())),
        T.StructField("marks", T.BinaryType()), T.StructField("payload", T.BinaryType())])
    # the row's place in the stored, ordered file: files are never larger than a part
    ordered = tokens.withColumn("seq", F.expr("_metadata.row_index")) if "seq" not in tokens.columns else tokens
    return ordered.mapInArrow(run, schema)


def write_ids(docs: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, np.ndarray]:
    """Tokenize, count, code and write; returns (stored blocks, code lengths)."""
    tokens = tokenize(docs, tokenizer)
    lengths = code_lengths(id_counts(tokens))
    blocks = store(encode_blocks(tokens, lengths), "token-blocks", "uncompressed")
    return blocks, lengths


def read_ids(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Documents decoded from the blocks: doc_id, part, seq, at (ids before it in the block), n_tokens, ids_crc32."""
    shared = blocks.sparkSession.sparkContext.broadcast(lengths)

    def run(batches):
        table = lookup(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]
                n = get("n_ids").as_py()
                ids = unpack(get("payload").as_py(), get("marks").as_py(), n, table).astype("<u4")
                sizes = np.array(get("doc_sizes").as_py(), dtype=np.int64)
                at = np.cumsum(sizes) - sizes
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * (a + m)]) for a, m in zip(at.tolist(), sizes.tolist())]
                k = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [get("doc_ids").values, pa.array([get("part").as_py()] * k, pa.int32()),
                     pa.array([get("seq").as_py()] * k, pa.int64()), pa.array(at), pa.array(sizes),
                     pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"])

    doc = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", doc), T.StructField("part", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in ("seq", "at", "n_tokens", "ids_crc32")]])
    return blocks.mapInArrow(run, schema)


def block_starts(blocks: DataFrame) -> DataFrame:
    """part, seq, start: ids before each block.  Parts are added up first, so only
    one row per part meets in one task; blocks are added up inside their part."""
    heads = blocks.select("part", "seq", "n_ids")
    parts = running_start(heads.groupBy("part").agg(F.sum("n_ids").alias("size")), "part", "size", "before")
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (heads.withColumn("inside", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))
            .join(parts.select("part", "before"), "part")
            .select("part", "seq", (F.col("before") + F.col("inside")).cast("long").alias("start")))


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write all documents' ids, read the files back: doc_id, start, n_tokens, ids_crc32.

    Defined cases: a null or empty text has the end id only; rows with equal
    ids stand in order of a hash of their text, null ids first; an empty table gives no
    blocks; other columns are ignored.
    """
    blocks, lengths = write_ids(docs, tokenizer)
    return (read_ids(blocks, lengths).join(block_starts(blocks), ["part", "seq"])
            .select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
