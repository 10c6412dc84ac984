"""Brown class-based bigram model: exchange clustering and scoring.

Tokens are words between ASCII white space, lower-cased (A-Z), then one end token.
P(token | previous) = P(class | previous class) * P(token | class).

* ``encode``: texts become token ids of their block, with one dictionary a block
  (word hashes, training counts), so later joins carry distinct words, not tokens.
* ``totals``: exact training counts of every word over all blocks, sent back to
  the blocks that hold the word.
* Words with at least ``MIN_COUNT`` training tokens are clustered, so the clustered
  vocabulary grows with the corpus.  They are numbered by a sort and their numbers
  joined to the blocks; tasks hold one byte of class a word, and for scoring one
  float.  Every other word belongs to one of eight shape classes (digits, non-ASCII letters, end in punctuation) and
  is emitted with its own count + 1 over the class's tokens, words and one unseen.
* ``cluster``: each round counts, for every clustered word, the classes before and
  after it over all training tokens, and moves half of the words to the class in
  which these contexts are most likely (the first-order gain of the exchange
  criterion sum T log T - 2 sum n log n).
* Class transitions are smoothed towards the class frequencies.

Defined cases: a null text has the end token only; a null id trains; without
training tokens every class and known count is empty and base scores are 0; an
empty table gives no rows; repeated rows are each counted and scored; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlens.llm import vectext as V
from listenlens.llm.common import crc_mod, drop_stored, numbered, store

CLASSES = 64
SHAPES = 8
ROUNDS = 8
MIN_COUNT = 3
# pseudo-count that pulls a class's transitions towards the class frequencies
PULL = 10.0
BLOCK_BYTES = 16 << 20
CHUNK = 4096
# context counts a task holds before it hands them on
HELD = 2 << 20
END = np.uint64(0x5BF03635E6C9D1A7)

_DIGIT = V.byte_table(range(0x30, 0x3A))
_HIGH = V.byte_table(range(0x80, 0x100))


def held_out():
    """Documents kept from training: crc32 of the id as text, modulo 7, is 2."""
    return crc_mod("doc_id", 7) == 2


# ---- tokens and counts ---------------------------------------------------------

def tokens_of(arr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, shapes, row offsets) of the tokens, each row closed by the end token."""
    h, off, starts, ends, data, _ = V.words(arr)
    shape = np.zeros(len(h), dtype=np.uint8)
    for bit, table in ((4, _DIGIT), (2, _HIGH)):
        c = np.concatenate([[0], np.cumsum(table[data])])
        shape |= ((c[ends] > c[starts]) * bit).astype(np.uint8)
    if len(h):
        shape |= ~V.ALNUM[data[ends - 1]]
    n = len(off) - 1
    at = off[1:]
    out = np.insert(h, at, END)
    return out, np.insert(shape, at, 0), off + np.arange(n + 1)


def encode(docs: DataFrame) -> DataFrame:
    """Rows of documents (block, doc_id, held_out, ids) and of block dictionaries
    (block, words, counts, shapes); stored."""
    def run(batches):
        place = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def block():
            words = np.concatenate([x[2] for x in held])
            shapes = np.concatenate([x[3] for x in held])
            u, first, ids = np.unique(words, return_index=True, return_inverse=True)
            ids = ids.astype("<u4")
            out = np.concatenate([x[1] for x in held])
            n_tokens = np.concatenate([np.diff(x[4]) for x in held])
            train = ids[np.repeat(~out, n_tokens)]
            counts = np.bincount(train, minlength=len(u)).astype("<u4")
            off = np.concatenate([[0], np.cumsum(n_tokens)])
            raw = ids.tobytes()
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([place] * n, pa.int64()), pa.concat_arrays([x[0] for x in held]), pa.array(out),
                 pa.array([raw[4 * a:4 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary()),
                 pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int64()), pa.nulls(1, held[0][0].type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()),
                 pa.array([u.astype("<u8").tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
                 pa.array([shapes[first].tobytes()], pa.binary())], names=names)

        for part in V.slices(batches, "text"):
            w, s, off = tokens_of(part.column("text"))
            out = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            held.append((part.column("doc_id"), out, w, s, off))
            size += part.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield from block()
                held, size, place = [], 0, place + 1
        if held:
            yield from block()

    names = ["block", "doc_id", "held_out", "ids", "words", "counts", "shapes"]
    d = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), d.schema["doc_id"], d.schema["held_out"],
                           *[T.StructField(c, T.BinaryType()) for c in names[3:]]])
    return store(d.mapInArrow(run, schema), "lm-encoded", "zstd")


def totals(encoded: DataFrame) -> DataFrame:
    """block, at (place in the block's dictionary), word, shape, total, first (one row a word); stored."""
    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                words = np.frombuffer(b.column("words")[i].as_buffer(), "<i8")
                n = len(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b.column("block")[i].as_py())), pa.array(np.arange(n, dtype=np.int32)),
                     pa.array(words), pa.array(np.frombuffer(b.column("counts")[i].as_buffer(), "<u4").astype(np.int64)),
                     pa.array(np.frombuffer(b.column("shapes")[i].as_buffer(), np.uint8).astype(np.int32))],
                    names=["block", "at", "word", "n", "shape"])

    words = (encoded.filter(F.col("words").isNotNull()).select("block", "words", "counts", "shapes")
             .mapInArrow(rows, "block long, at int, word long, n long, shape int"))
    w = Window.partitionBy("word")
    return store(words.select("block", "at", "word", "shape", F.sum("n").over(w).alias("total"),
                              (F.row_number().over(w.orderBy("block")) == 1).alias("first")), "lm-totals", "zstd")


class Vocabulary:
    """Training totals and the clustered words, most frequent first.

    Ids 0 .. n-1 are the clustered words, n + s the shape classes, n + SHAPES the end.
    """

    def __init__(self, counts: DataFrame, min_share: float = 0.0):
        end = int(END.astype(np.int64))
        one = counts.filter("first")
        s = one.agg(F.sum("total").alias("tokens"), F.sum((F.col("total") > 0).cast("long")).alias("words")).first()
        self.tokens, self.distinct = int(s.tokens or 0), int(s.words or 0)
        least = max(MIN_COUNT, min_share * self.tokens)
        #: word, index (id) of the clustered words
        self.words = store(numbered(one.filter((F.col("total") >= least) & (F.col("word") != end))
                                    .select("word", "total", (-F.col("total")).alias("less")), ["less", "word"], "lm-sorted")
                           .select("word", "total", "index"), "lm-words", "zstd")
        rows = self.words.select("index", "total").toArrow()
        self.n = rows.num_rows
        self.total = np.zeros(self.n, dtype=np.int64)
        self.total[rows.column("index").to_numpy()] = rows.column("total").to_numpy()
        rest = (one.filter((F.col("total") < least) & (F.col("total") > 0) & (F.col("word") != end)).groupBy("shape")
                .agg(F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("words")).collect())
        # rare tokens, rare words and one unseen word of each shape
        self.shape_mass = np.ones(SHAPES)
        for r in rest:
            self.shape_mass[r["shape"]] += r.tokens + r.words

    @property
    def end(self) -> int:
        return self.n + SHAPES


def base_scored(encoded: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, rare (log10 emission of shape
    class words), gids (vocabulary ids); stored."""
    n, end, log_all, mass = vocab.n, vocab.end, np.log10(vocab.tokens + vocab.distinct + 1.0), vocab.shape_mass

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        is_dict = left.column("words").is_valid()
        d = left.filter(is_dict)
        words = np.frombuffer(d.column("words")[0].as_buffer(), "<u8")
        shapes = np.frombuffer(d.column("shapes")[0].as_buffer(), np.uint8)
        total = np.zeros(len(words), dtype=np.int64)
        at = right.column("at").to_numpy()
        total[at] = right.column("total").to_numpy()
        # ids of the dictionary: clustered word, end, or shape class
        gid = n + shapes.astype(np.int64)
        known = right.column("index").to_numpy()
        gid[at[known >= 0]] = known[known >= 0]
        gid[words == END] = end
        log_base = np.log10(total + 1.0) - log_all
        rare = np.zeros(len(words))
        shaped = (gid >= n) & (gid < end)
        rare[shaped] = np.log10(total[shaped] + 1.0) - np.log10(mass[gid[shaped] - n])
        docs = left.filter(pa.compute.invert(is_dict))
        ids = [np.frombuffer(v.as_buffer(), "<u4") for c in docs.column("ids").chunks for v in c]
        gid32 = gid.astype("<u4")
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"),
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "n_known": pa.array([int((total[x] > 0).sum()) for x in ids], pa.int64()),
            "base_score": pa.array([float(log_base[x].sum()) for x in ids]),
            "rare": pa.array([float(rare[x].sum()) for x in ids]),
            "gids": pa.array([gid32[x].tobytes() for x in ids], pa.binary())})

    schema = T.StructType([encoded.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("rare", T.DoubleType()),
                           T.StructField("gids", T.BinaryType())])
    left = encoded.select("block", "doc_id", "held_out", "ids", "words", "shapes").groupBy("block")
    right = (counts.join(vocab.words.select("word", "index"), "word", "left")
             .select("block", "at", "total", F.coalesce("index", F.lit(-1).cast("long")).alias("index")).groupBy("block"))
    return store(left.cogroup(right).applyInArrow(run, schema), "lm-ids", "zstd")


# ---- classes -------------------------------------------------------------------

def _sequence(part: pa.RecordBatch) -> np.ndarray:
    data, _ = V.buffers(part.column("gids"))
    return np.frombuffer(data.tobytes(), "<u4")


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)


def context_counts(ids: DataFrame, class_of: np.ndarray, vocab: Vocabulary) -> DataFrame:
    """part, before, n_before, after, n_after: context class counts of CHUNK words a row, over all
    training tokens, as places in the (word, class) square that are not 0 and their counts; stored."""
    n_words, n_classes = len(class_of), int(class_of.max()) + 1
    shared = ids.sparkSession.sparkContext.broadcast(class_of.astype(np.uint8))
    end, step = vocab.end, CHUNK * n_classes
    edges = np.arange(0, n_words + CHUNK, CHUNK, dtype=np.int64) * n_classes
    names = ["part", "before", "n_before", "after", "n_after"]

    def count(batches):
        cls = shared.value
        held: list[list[np.ndarray]] = [[], [], [], []]

        def flush():
            columns = [np.arange(len(edges) - 1, dtype=np.int32)]
            for k in (0, 2):
                u, n = _merged(held[k], held[k + 1])
                cut = np.searchsorted(u, edges).tolist()
                places, n = (u % step).astype("<u4").tobytes(), n.astype("<u4").tobytes()
                for raw in (places, n):
                    columns.append([raw[4 * i:4 * j] for i, j in zip(cut[:-1], cut[1:])])
            on = [i for i in range(len(edges) - 1) if columns[1][i] or columns[3][i]]
            return pa.RecordBatch.from_arrays([pa.array([int(i) for i in on], pa.int32()), *[
                pa.array([c[i] for i in on], pa.binary()) for c in columns[1:]]], names=names)

        for part in V.slices(batches, "gids"):
            g = _sequence(part).astype(np.int64)
            if not len(g):
                continue
            # every document ends with the end token, which also precedes its first word
            c = cls[g].astype(np.int64)
            pair = g * n_classes
            keep = g[:-1] != end
            # the end token is followed by the first word of the next document
            first = np.concatenate([[c[0]], c[1:][~keep]])
            for k, keys in ((0, pair + np.concatenate([[int(cls[end])], c[:-1]])),
                            (2, np.concatenate([pair[:-1][keep] + c[1:][keep], end * n_classes + first]))):
                at, n = np.unique(keys, return_counts=True)
                held[k].append(at)
                held[k + 1].append(n)
            if sum(map(len, held[0])) >= HELD:
                yield flush()
                held = [[], [], [], []]
        if held[0]:
            yield flush()

    def add(batches):
        # sums of the part at hand, and rows to add to them
        now, sums, more, size = None, None, [], 0

        def merged():
            rows = ([] if sums is None else [sums]) + more
            return [x for k in (0, 2) for x in _merged([r[k] for r in rows], [r[k + 1] for r in rows])]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *[
                pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(merged(), ("<u4", "<i8") * 2)]], names=names)

        for b in batches:
            for p, *raw in zip(*(b.column(c).to_pylist() for c in names)):
                if p != now:
                    if now is not None:
                        yield row()
                    now, sums, more, size = p, None, [], 0
                more.append([np.frombuffer(x, "<u4") for x in raw])
                size += len(raw[0])
                if size >= 4 * HELD:
                    sums, more, size = merged(), [], 0
        if now is not None:
            yield row()

    schema = "part int, before binary, n_before binary, after binary, n_after binary"
    return store(ids.filter("not held_out").select("gids").mapInArrow(count, schema)
                 .repartition("part").sortWithinPartitions("part").mapInArrow(add, schema), "lm-contexts", "zstd")


def _square(part: int, places: bytes, counts: bytes, n_words: int, n_classes: int) -> np.ndarray:
    """Counts of a part's words (rows) and context classes."""
    out = np.zeros((min(CHUNK, n_words - part * CHUNK), n_classes), dtype=np.int64)
    out.ravel()[np.frombuffer(places, "<u4")] = np.frombuffer(counts, "<i8")
    return out


def transitions(contexts: DataFrame, class_of: np.ndarray) -> np.ndarray:
    """Class bigram counts: a square of the class count reaches the driver from every part."""
    n, n_words = int(class_of.max()) + 1, len(class_of)
    shared = contexts.sparkSession.sparkContext.broadcast(class_of.astype(np.uint8))

    def run(batches):
        t = np.zeros((n, n), dtype=np.int64)
        for b in batches:
            for p, x, y in zip(*(b.column(c).to_pylist() for c in ("part", "before", "n_before"))):
                rows = _square(p, x, y, n_words, n)
                np.add.at(t.T, shared.value[p * CHUNK:p * CHUNK + len(rows)], rows)
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary())], names=["t"])

    parts = contexts.select("part", "before", "n_before").mapInArrow(run, "t binary").collect()
    return sum((np.frombuffer(r.t, "<i8").reshape(n, n) for r in parts), np.zeros((n, n), dtype=np.int64))


def reassign(contexts: DataFrame, class_of: np.ndarray, t: np.ndarray, movable: int, turn: int) -> np.ndarray:
    """The next class of every word: words whose number has this turn's parity move to their best class."""
    n, n_words = len(t), len(class_of)
    out_n, in_n = t.sum(axis=1), t.sum(axis=0)
    # log of T[c, k] / n_k: how likely a context class is around class k
    left = np.log((t + 0.1) / (in_n + 0.1 * n)[None, :])[:, :CLASSES]
    right = np.log((t + 0.1) / (out_n + 0.1 * n)[:, None])[:CLASSES].T
    shared = contexts.sparkSession.sparkContext.broadcast((left, right))

    def run(batches):
        le, ri = shared.value
        for b in batches:
            for p, x, nx, y, ny in zip(*(b.column(c).to_pylist() for c in ("part", "before", "n_before", "after", "n_after"))):
                gain = (_square(p, x, nx, n_words, n) @ le) + (_square(p, y, ny, n_words, n) @ ri)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([gain.argmax(axis=1).astype("<u1").tobytes()], pa.binary())],
                    names=["part", "best"])

    new = class_of.copy()
    for r in contexts.mapInArrow(run, "part int, best binary").collect():
        best = np.frombuffer(r.best, "<u1")
        word = np.arange(r.part * CHUNK, r.part * CHUNK + len(best))
        move = (word < movable) & ((word + turn) % 2 == 0)
        new[word[move]] = best[move]
    return new


def cluster(ids: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of every id, class bigram counts)."""
    class_of = np.concatenate([np.arange(vocab.n) % CLASSES, CLASSES + np.arange(SHAPES + 1)])
    for turn in range(rounds):
        contexts = context_counts(ids, class_of, vocab)
        new = reassign(contexts, class_of, transitions(contexts, class_of), vocab.n, turn)
        drop_stored(contexts)
        still = (new == class_of).all()
        class_of = new
        if still and turn:
            break
    contexts = context_counts(ids, class_of, vocab)
    t = transitions(contexts, class_of)
    drop_stored(contexts)
    return class_of, t


def log_model(class_of: np.ndarray, t: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P(class | previous class), log10 P(clustered word | class); 0 for shapes and the end)."""
    n = len(t)
    prior = (t.sum(axis=0) + 1.0) / (t.sum() + n)
    move = (t + PULL * prior[None, :]) / (t.sum(axis=1) + PULL)[:, None]
    size = np.bincount(class_of[:vocab.n], weights=vocab.total, minlength=n)
    emit = np.zeros(len(class_of))
    emit[:vocab.n] = np.log10(vocab.total / size[class_of[:vocab.n]])
    return np.log10(move), emit


def score(docs: DataFrame, rounds: int = ROUNDS, min_share: float = 0.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; a row per document row."""
    encoded = encode(docs)
    counts = totals(encoded)
    vocab = Vocabulary(counts, min_share)
    ids = base_scored(encoded, counts, vocab)
    drop_stored(vocab.words)
    drop_stored(counts)
    drop_stored(encoded)
    class_of, t = cluster(ids, vocab, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((class_of, *log_model(class_of, t, vocab)))
    end = vocab.end

    def run(batches):
        cls, move, emit = shared.value
        for part in V.slices(batches, "gids"):
            g = _sequence(part)
            c = cls[g]
            log_p = move[np.concatenate([[cls[end]], c[:-1]]), c] + emit[g]
            off = np.concatenate([[0], np.cumsum(part.column("n_tokens").to_numpy())])
            total = np.add.reduceat(log_p, off[:-1]) + part.column("rare").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(total)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    schema = T.StructType([*(ids.schema[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")),
                           T.StructField("score", T.DoubleType())])
    return (ids.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "rare", "gids").mapInArrow(run, schema)
            .withColumn("train_tokens", F.lit(vocab.tokens).cast("long"))
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
