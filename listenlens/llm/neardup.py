"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. ``shingle_df``: document frequencies of the common five-word shingles, exact
   for every shingle found in at least 1/``RARE`` of the documents (a count sketch
   over all documents finds the candidates, a second pass counts them).
2. ``signatures``: texts with the same words share a ``sig``; each text gets
   ``BANDS`` x ``ROWS`` ICWS samples of its weighted shingles, hashed by band.
   Two texts agree in a sample with a chance equal to their weighted Jaccard
   similarity J, so at J = 0.8 a pair meets in some band with a chance of 0.998.
3. ``links``: in every bucket a few leaders are compared with all others by
   exact weighted Jaccard similarity, round after round, until the members that
   never led belong to one class; an upper bound of the similarity leaves out
   pairs that cannot reach the threshold.  No bucket is cut and no task holds one.
4. ``components``: classes are the connected components of the links.

A shingle's weight is (1 + ln tf) * idf with idf = 1 + ``IDF`` * ln(N / df) scaled
to [0, 1]: common passages weigh less, but a large group of copies, whose
shingles are common by being copied, keeps its similarity.  Words are runs of
letters and digits, lower-cased (ASCII); a text of fewer than five words is one
shingle.

Defined cases: a text without a word (null and empty too) is a class of its own;
rows that repeat a text share its class; a class id is the least id that is not
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlens.llm import vectext as V
from listenlens.llm.common import drop_stored, fresh, store, text_key

WORDS = 5
SIMILAR = 0.8
ROWS, BANDS = 4, 12
RARE = 500
IDF = 0.05
SKETCH = 1 << 20
SKETCH_ROW = 1 << 12
# leaders of a bucket in the second round; four times as many in each later one
LEADERS = 16
# a shingle that no more of the compared texts have is rare among them
FEW = 6
SLICE = 1 << 19

_SEEDS = V.mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * V._C1)


def _gamma2() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the midpoints of 2^16 steps."""
    x = np.concatenate([np.geomspace(1e-6, 1, 40_000), np.linspace(1, 30, 40_000)[1:]])
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - np.exp(-x) * (1 + x), x)


_R = _gamma2().astype(np.float32)
_LOG_C = np.log(_gamma2()).astype(np.float32)
_BETA = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def all_shingles(arr, k: int = WORDS):
    """(hashes, row offsets, sig halves, words a row) of all shingles, in text order."""
    h, off, *_ = V.words(arr, V.ALNUM)
    sh, sh_off = V.shingles(h, off, k)
    return sh, sh_off, (V.sequence_hash(h, off, 1), V.sequence_hash(h, off, 2)), np.diff(off)


def distinct(s: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of one occurrence of every shingle of a row, its count): rows stay in order."""
    key = V.mix(s ^ V.mix(row.astype(np.uint64) + V._C1))
    order = np.argsort(key)
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    mask, count = np.zeros(len(s), dtype=bool), np.zeros(len(s), dtype=np.int64)
    mask[order[first]] = True
    count[order[first]] = np.diff(np.append(first, len(k)))
    return mask, count[mask]


def distinct_shingles(arr, k: int = WORDS):
    """(hashes, counts, row offsets, sig halves, words a row): distinct shingles by row."""
    s, off, halves, n_words = all_shingles(arr, k)
    row = V.rows_of(off)
    mask, tf = distinct(s, row)
    return s[mask], tf, np.concatenate([[0], np.cumsum(mask)])[off], halves, n_words


def sigs(halves, n_words) -> pa.Array:
    """16 bytes that stand for a text's words; null without a word."""
    both = np.stack(halves, axis=1).astype("<u8").tobytes()
    return pa.array([both[16 * i:16 * i + 16] if n else None for i, n in enumerate(n_words)], pa.binary())


# ---- document frequencies -----------------------------------------------------

def shingle_df(docs: DataFrame, k: int = WORDS, rare: int = RARE):
    """(documents, least df counted, hashes, dfs) of the shingles in 1/rare of all documents.

    At most ``rare`` times the mean number of shingles a document can reach that,
    so the table is bounded whatever the number of documents.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    n_docs = texts.count()
    least = max(2, -(-n_docs // rare))

    def sketch(batches):
        total = np.zeros(SKETCH, dtype=np.int64)
        for part in V.slices(batches, "text"):
            # occurrences bound documents from above, so no frequent shingle is missed
            s, *_ = all_shingles(part.column("text"), k)
            total += np.bincount((s & np.uint64(SKETCH - 1)).view(np.int64), minlength=SKETCH)
        for i in range(0, SKETCH, SKETCH_ROW):
            row = total[i:i + SKETCH_ROW]
            if row.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // SKETCH_ROW], pa.int32()), pa.array([row.astype("<u4").tobytes()], pa.binary())],
                    names=["part", "counts"])

    def heavy(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
                v = np.frombuffer(c, dtype="<u4").astype(np.int64)
                sums[i] = sums[i] + v if i in sums else v
        for i, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([np.packbits(v >= least).tobytes()], pa.binary())],
                names=["part", "bits"])

    found = (texts.mapInArrow(sketch, "part int, counts binary").repartition("part")
             .mapInArrow(heavy, "part int, bits binary").collect())
    bits = np.zeros(SKETCH, dtype=bool)
    for r in found:
        bits[r.part * SKETCH_ROW:(r.part + 1) * SKETCH_ROW] = np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def count(batches):
        flags = np.unpackbits(shared.value).astype(bool)
        for part in V.slices(batches, "text"):
            s, off, *_ = all_shingles(part.column("text"), k)
            on = flags[(s & np.uint64(SKETCH - 1)).view(np.int64)]
            s, row = s[on], V.rows_of(off)[on]
            u, n = np.unique(s[distinct(s, row)[0]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["h", "n"])

    rows = (texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least).toArrow())
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return n_docs, least, h[order], rows.column("n").to_numpy()[order]


def weights(s: np.ndarray, tf: np.ndarray, stats) -> np.ndarray:
    """TF-IDF weight of shingles."""
    n_docs, least, h, df = stats
    rare = np.log((n_docs + 1) / (least + 1))
    idf = np.full(len(s), 1.0 + IDF if rare > 0 else 1.0)
    if len(h) and rare > 0:
        at = np.minimum(np.searchsorted(h, s), len(h) - 1)
        on = h[at] == s
        idf[on] = 1.0 + IDF * np.log((n_docs + 1) / (df[at[on]] + 1)) / rare
    return (1.0 + np.log(tf)) * idf


# ---- signatures ---------------------------------------------------------------

def icws(s: np.ndarray, w: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Band hashes (rows x BANDS) of weighted sets; every row has an element.

    For each sample: r, c from Gamma(2, 1) and beta from U(0, 1), all by hash of
    the element; t = floor(ln w / r + beta); the element with the least
    ln c - r (t - beta + 1) is drawn, together with its t.
    """
    n = len(off) - 1
    count = np.diff(off)
    log_w = np.log(w).astype(np.float32)
    out = np.zeros((n, BANDS), dtype=np.uint64)
    low = np.uint64(0xFFFF)
    for j, seed in enumerate(_SEEDS):
        x = V.mix(s ^ seed)
        r = _R[x & low]
        beta = _BETA[(x >> np.uint64(16)) & low]
        t = np.floor(log_w / r + beta)
        a = _LOG_C[(x >> np.uint64(32)) & low] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(a, off[:-1])
        at = np.flatnonzero(a == np.repeat(least, count))
        row = np.searchsorted(off, at, side="right") - 1
        at = at[np.concatenate([[True], row[1:] != row[:-1]])]
        drawn = V.mix(s[at] ^ V.mix(t[at].astype(np.int64).view(np.uint64) + seed))
        band = j // ROWS
        out[:, band] = V.mix(out[:, band] * V._C1 + drawn)
    return out


def signatures(docs: DataFrame, stats, k: int = WORDS) -> DataFrame:
    """doc_id, sig, weight, bands of every row; stored."""
    shared = docs.sparkSession.sparkContext.broadcast(stats)

    def run(batches):
        for part in V.slices(batches, "text", SLICE):
            s, tf, off, halves, n_words = distinct_shingles(part.column("text"), k)
            w = weights(s, tf, shared.value)
            sig = sigs(halves, n_words)
            total = V.segment_sums(w, off)
            # copies in the slice are sampled once; rows without a shingle never
            _, first, back = np.unique(halves[0], return_index=True, return_inverse=True)
            first = first[n_words[first] > 0]
            bands: list = [None] * part.num_rows
            if len(first):
                take = np.concatenate([np.arange(off[i], off[i + 1]) for i in first])
                sub = np.concatenate([[0], np.cumsum(off[first + 1] - off[first])])
                got = icws(s[take], w[take], sub).view(np.int64)
                by = {int(back[i]): got[n] for n, i in enumerate(first)}
                bands = [by.get(int(b)) if n else None for b, n in zip(back, n_words)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), sig, pa.array(total), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "sig", "weight", "bands"])

    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([d.schema["doc_id"], T.StructField("sig", T.BinaryType()),
                           T.StructField("weight", T.DoubleType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return store(d.mapInArrow(run, schema), "dup-sigs")


def vectors(docs: DataFrame, wanted: DataFrame, stats, k: int = WORDS) -> DataFrame:
    """sig, h (sorted 32-bit shingle hashes), w (their weights) of the wanted texts; stored.

    ``wanted`` names one row of each text (sig and id key), so copies are neither
    shuffled to one place nor coded twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(stats)

    def sign(batches):
        for part in V.slices(batches, "text"):
            h, off, *_ = V.words(part.column("text"), V.ALNUM)
            halves = V.sequence_hash(h, off, 1), V.sequence_hash(h, off, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("text"), sigs(halves, np.diff(off))], names=["doc", "text", "sig"])

    def code(batches):
        for part in V.slices(batches, "text", SLICE):
            s, tf, off, *_ = distinct_shingles(part.column("text"), k)
            w = weights(s, tf, shared.value).astype("<f4")
            s = s.astype("<u4")
            hs, ws = [], []
            for a, b in zip(off[:-1], off[1:]):
                order = np.argsort(s[a:b], kind="stable")
                hs.append(s[a:b][order].tobytes())
                ws.append(w[a:b][order].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("sig"), pa.array(hs, pa.binary()), pa.array(ws, pa.binary())], names=["sig", "h", "w"])

    d = docs.select(text_key("doc_id").alias("doc"), F.col("text").cast("string").alias("text"))
    signed = d.mapInArrow(sign, "doc string, text string, sig binary")
    return store(signed.join(wanted, ["sig", "doc"]).select("sig", "text")
                 .mapInArrow(code, "sig binary, h binary, w binary").dropDuplicates(["sig"]), "dup-vectors", "zstd")


# ---- links and classes ----------------------------------------------------------

def similarity(ha: bytes, wa: bytes, hb: bytes, wb: bytes) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima."""
    a, b = np.frombuffer(ha, "<u4"), np.frombuffer(hb, "<u4")
    x, y = np.frombuffer(wa, "<f4").astype(np.float64), np.frombuffer(wb, "<f4").astype(np.float64)
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    on = a[at] == b
    both = np.minimum(x[at[on]], y[on]).sum()
    return float(both / (x.sum() + y.sum() - both))


def verify(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """a, b, sim of the pairs."""
    def run(batches):
        for p in batches:
            sims = [similarity(*x) for x in zip(*(p.column(c).to_pylist() for c in ("ha", "wa", "hb", "wb")))]
            yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b"), pa.array(sims, pa.float64())],
                                             names=["a", "b", "sim"])

    one = vecs.select(F.col("sig").alias("b"), F.col("h").alias("hb"), F.col("w").alias("wb"))
    two = vecs.select(F.col("sig").alias("a"), F.col("h").alias("ha"), F.col("w").alias("wa"))
    return pairs.join(one, "b").join(two, "a").mapInArrow(run, "a binary, b binary, sim double")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component); stored.

    Every round a node takes the least label around it, then its label's label.
    """
    both = store(edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
                 .union(edges.select("b", "a")).distinct(), "dup-edges")
    labels = store(both.groupBy("node").agg(F.min("other").alias("other"))
                   .select("node", F.least("node", "other").alias("label")), "dup-labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        near = both.join(seen, "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = (labels.join(near, "node")
                .select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label")))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = store(step.join(ahead, "label").select("node", "old", F.least("label", "next").alias("label")), "dup-labels")
        same = new.filter(F.col("old") != F.col("label")).isEmpty()
        drop_stored(labels)
        labels = new.select("node", "label")
        if same:
            drop_stored(both)
            return labels


def buckets(texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """bucket, sig, weight for buckets of two or more texts; stored.

    A bucket is a band hash within a class of total weights: texts whose weights
    differ by more than 1/similar cannot be similar, and any two closer ones
    share one of their two weight classes.
    """
    step = F.floor(F.log(F.col("weight")) / float(np.log(1 / similar))).cast("long")
    rows = (texts.withColumn("c", F.explode(F.array(step, step + 1)))
            .select("sig", "weight", "c", F.posexplode("bands").alias("band", "h"))
            .select(F.xxhash64("band", "h", "c").alias("bucket"), "sig", "weight"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    return store(rows.join(shared, "bucket"), "dup-buckets")


def rare_shingles(texts: DataFrame, vecs: DataFrame) -> DataFrame:
    """h, sig, w of the shingles that at most ``FEW`` of the given texts have; stored."""
    def rows(batches):
        for b in batches:
            hs = [np.frombuffer(v.as_buffer(), "<u4").astype(np.int64) for v in b.column("h")]
            ws = [np.frombuffer(v.as_buffer(), "<f4").astype(np.float64) for v in b.column("w")]
            if hs:
                sig = b.column("sig").take(pa.array(np.repeat(np.arange(len(hs)), [len(x) for x in hs])))
                yield pa.RecordBatch.from_arrays([sig, pa.array(np.concatenate(hs)), pa.array(np.concatenate(ws))],
                                                 names=["sig", "h", "w"])

    every = vecs.join(texts, "sig").select("sig", "h", "w").mapInArrow(rows, "sig binary, h long, w double")
    few = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= FEW).select("h")
    return store(every.join(few, "h"), "dup-rare")


def rare_pairs(rare: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """a, b: pairs of texts that share a rare shingle and may still be similar.

    Beyond the rare shingles they share, they share no more than the lesser weight
    of what else they have.  ``texts``: sig, weight, alone (weight of rare shingles).
    """
    holders = rare.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("sig", "w"))).alias("x")).filter(F.size("x") > 1)
    pair = F.expr("flatten(transform(x, (u, i) -> transform(slice(x, i + 2, size(x)), v -> "
                  "named_struct('a', u.sig, 'b', v.sig, 'w', least(u.w, v.w)))))")
    shared = holders.select(F.inline(pair)).groupBy("a", "b").agg(F.sum("w").alias("both"))
    side = lambda x: texts.select(F.col("sig").alias(x), F.col("weight").alias(f"w{x}"),
                                  (F.col("weight") - F.col("alone")).alias(f"s{x}"))
    most = F.least("sa", "sb") + F.col("both")
    return (shared.join(side("a"), "a").join(side("b"), "b")
            .filter(most * (1 + similar) >= similar * (F.col("wa") + F.col("wb")) * (1 - 1e-6)).select("a", "b"))


def prune(members: DataFrame, vecs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(members with ``alone``, links of pairs that share a rare shingle); stored.

    In buckets of many texts the weight of a text's rare shingles is taken.  Pairs
    that share one are compared here; any other pair shares none, so no text there
    whose other shingles weigh too little can be similar to any.
    """
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > LEADERS)
    sized = members.join(size, "bucket", "left")
    full = store(sized.filter("texts IS NOT NULL").select("sig", "weight").distinct(), "dup-full")
    rare = rare_shingles(full.select("sig"), vecs)
    full = store(full.join(rare.groupBy("sig").agg(F.sum("w").alias("alone")), "sig", "left")
                 .select("sig", "weight", F.coalesce("alone", F.lit(0.0)).alias("alone")), "dup-alone")
    linked = store(verify(rare_pairs(rare, full, similar), vecs).filter(F.col("sim") >= similar).select("a", "b"), "dup-linked")
    drop_stored(rare)
    alone = F.when(F.col("texts").isNotNull(), F.col("alone")).otherwise(F.lit(0.0))
    kept = (sized.join(full.select("sig", "alone"), "sig", "left").withColumn("alone", alone)
            .filter(F.col("weight") - F.col("alone") >= similar * F.col("weight") * (1 - 1e-6)))
    return store(kept.select("bucket", "sig", "weight", "alone"), "dup-buckets"), linked


def links(members: DataFrame, vecs: DataFrame, similar: float = SIMILAR) -> DataFrame | None:
    """label of every linked text (node, label); None without a link.

    Rare shingles first leave out what cannot be similar to anything (texts that only
    share a passage, copies with many edits).  In the first round the text of each
    bucket that has least of its own is compared with all others, which settles
    groups of copies.  In later rounds the members of a bucket's smallest classes are
    compared with all others, until what never led is one class.
    """
    members, linked = prune(members, vecs, similar)
    members = members.withColumn("led", F.lit(False))
    edges, labels, leaders = None, None, 1
    while True:
        if not linked.isEmpty():
            edges = linked if edges is None else edges.union(linked)
            labels = components(edges)
        state = members.withColumn("class", F.col("sig")) if labels is None else (
            members.join(labels.withColumnRenamed("node", "sig"), "sig", "left")
            .withColumn("class", F.coalesce("label", "sig")).drop("label"))
        # a bucket is open while members that never led are in two classes
        state = store(state, "dup-state")
        by_class = state.filter("not led").groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
        opened = by_class.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("bucket")
        live = store(state.join(opened, "bucket").join(by_class, ["bucket", "class"], "left"), "dup-live")
        drop_stored(state)
        if live.isEmpty():
            return labels
        # later leaders come from the smallest classes: what is left then is one class
        order = [F.col("alone") / F.col("weight"), F.col("sig")] if leaders == 1 else [F.col("n"), F.col("sig")]
        w = Window.partitionBy("bucket").orderBy(*order)
        ranked = (live.filter("not led").withColumn("place", F.row_number().over(w))
                  .filter(F.col("place") <= leaders))
        lead = store(ranked.select("bucket", F.col("sig").alias("a"), F.col("weight").alias("wa"),
                                   (F.col("weight") - F.col("alone")).alias("sa"), F.col("class").alias("ca"), "place"), "dup-lead")
        now = store(live.join(lead.select("bucket", F.col("a").alias("sig"), "place"), ["bucket", "sig"], "left"), "dup-now")
        drop_stored(live)
        others = now.filter("not led").select("bucket", F.col("sig").alias("b"), F.col("weight").alias("wb"),
                                              (F.col("weight") - F.col("alone")).alias("sb"),
                                              F.col("class").alias("cb"), F.coalesce("place", F.lit(1 << 30)).alias("after"))
        # no more can be shared than the lesser weight without rare shingles
        most = F.least("sa", "sb")
        pairs = (others.join(lead, "bucket")
                 .filter((F.col("after") > F.col("place")) & (F.col("ca") != F.col("cb"))
                         & (most * (1 + similar) >= similar * (F.col("wa") + F.col("wb")) * (1 - 1e-6)))
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        linked = store(verify(pairs, vecs).filter(F.col("sim") >= similar).select("a", "b"), "dup-linked")
        members = now.select("bucket", "sig", "weight", "alone", (F.col("led") | F.col("place").isNotNull()).alias("led"))
        # few pairs pass the bound by now, so ever more leaders go at once
        leaders = LEADERS if leaders == 1 else 4 * leaders


def classes(docs: DataFrame, k: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """doc_id, sig, root (the class's own key), class_id (its least id), class_size (rows); one row per document row."""
    stats = shingle_df(docs, k)
    rows = signatures(docs, stats, k)
    doc = text_key("doc_id")
    texts = store(rows.filter(F.col("sig").isNotNull()).groupBy("sig")
                  .agg(F.min(doc).alias("doc"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"),
                       F.first("weight").alias("weight"), F.first("bands").alias("bands")), "dup-texts")
    members = buckets(texts, similar)
    wanted = members.select("sig").distinct().join(texts.select("sig", "doc"), "sig")
    vecs = vectors(docs, wanted, stats, k)
    labels = links(members, vecs, similar)
    named = texts.select("sig", "least", "n")
    if labels is None:
        by_text = named.select("sig", F.col("sig").alias("root"), F.col("least").alias("class_id"), F.col("n").alias("class_size"))
    else:
        root = (named.join(labels.withColumnRenamed("node", "sig"), "sig", "left")
                .withColumn("root", F.coalesce("label", "sig")))
        of_root = root.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
        by_text = store(root.select("sig", "root").join(of_root, "root"), "dup-classes")
    return (rows.select("doc_id", "sig").join(by_text, "sig", "left")
            .select("doc_id", "sig", "root",
                    F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")))


def keep_one(docs: DataFrame, k: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """The documents with one row of each class, that of its least id; all columns kept.

    Texts without a word all stay.
    """
    names, (doc, sig, times) = docs.columns, fresh(docs, "_doc", "_sig", "_times")
    found = (classes(docs, k, similar)
             .filter(F.col("sig").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))))
    # an id that stands for several texts of its class keeps the least of them
    kept = store(found.groupBy(text_key("doc_id").alias(doc), "root", "sig").agg(F.count(F.lit(1)).alias("n"))
                 .groupBy(doc, "root").agg(F.min(F.struct("sig", "n")).alias("x"))
                 .select(doc, F.col("x.sig").alias(sig), F.col("x.n").alias(times)), "dup-kept")

    def sign(batches):
        for part in V.slices(batches, "text"):
            h, off, *_ = V.words(part.column("text"), V.ALNUM)
            got = sigs((V.sequence_hash(h, off, 1), V.sequence_hash(h, off, 2)), np.diff(off))
            yield pa.RecordBatch.from_arrays([*part.columns, got], names=[*part.schema.names, sig])

    signed = (docs.withColumn(doc, text_key("doc_id"))
              .mapInArrow(sign, T.StructType([*docs.schema.fields, T.StructField(doc, T.StringType()),
                                              T.StructField(sig, T.BinaryType())])))
    one = signed.join(kept, [doc, sig])
    # only rows that repeat both id and text have to be brought together
    again = one.filter(F.col(times) > 1).dropDuplicates([doc, sig])
    some = one.filter(F.col(times) == 1).select(*names)
    if not kept.filter(F.col(times) > 1).isEmpty():
        some = some.unionByName(again.select(*names))
    return some.unionByName(signed.filter(F.col(sig).isNull()).select(*names))
