"""Quality ledger, decontamination and language ID against brute force."""

import collections
import hashlib
import re

import pyarrow as pa
import pytest

from listenlens.llm import decontam, langid, quality, queries
from listenlens.llm import vectext as V
from listenlens.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm import frames
from tests.oracle_check import compare, duck

WORD = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    r = compare(spark, duck(SF_SMALL), name, queries.QUERIES[name], queries.ORACLES[name], SF_SMALL)
    assert r["ok"], r


def test_word_hashes_tell_words_apart():
    texts = [None, "", "A b", "a B c", "x" * 600 + " y", "é É", "a" * 9 + " " + "a" * 10]
    h, off, *_ = V.words(pa.array(texts, pa.string()))
    ws = [w for t in texts for w in re.findall(WORD, t or "")]
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in ws]
    assert list(off) == [0, *list(__import__("itertools").accumulate(len(re.findall(WORD, t or "")) for t in texts))]
    assert len(set(h.tolist())) == len(set(low))
    assert {w: x for w, x in zip(low, h.tolist())} == dict(zip(low, h.tolist()))


def measures(text):
    text = text or ""
    w = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    c = collections.Counter(zip(w, w[1:], w[2:]))
    rep = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep))


def test_ledger_on_awkward_rows(spark):
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                 for r in quality.ledger(frames.edge_docs(spark)).collect())
    assert got == sorted((r[0] or -1, *measures(r[1])) for r in frames.edge_rows())


def test_policies_and_ablation_agree_with_the_bits(spark):
    led = quality.ledger(table(spark, SF_SMALL, "documents")).cache()
    rows = led.collect()
    for version, mask in quality.POLICIES.items():
        kept = {r.doc_id for r in quality.apply_policy(led, version).collect() if r.kept}
        assert kept == {r.doc_id for r in rows if r.failed_bits & (mask | quality.POLICIES["base-1"]) == 0}
        for r in quality.ablation(led, version).collect():
            bit = quality.BIT[r.rule]
            bits = [x.failed_bits & mask for x in rows]
            assert (r.n_failed, r.n_only, r.n_kept_without) == (
                sum(b & bit != 0 for b in bits), sum(b == bit for b in bits), sum(b in (0, bit) for b in bits))
    led.unpersist()
    assert quality.quality(frames.no_docs(spark)).count() == 0


def brute_hits(text, items, window=10):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.findall(word, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    ws, hit, found = low(text), set(), set()
    for i, t in items:
        iw = low(t)
        k = min(window, len(iw))
        for j in range(len(iw) - k + 1 if k else 0):
            for s in range(len(ws) - k + 1):
                if ws[s:s + k] == iw[j:j + k]:
                    hit |= set(range(s, s + k))
                    found.add(None if i is None else str(i))
    return len(ws), len(hit), sorted(found, key=lambda x: (x is None, x or ""))


def test_decontamination_on_awkward_rows(spark):
    docs = frames.edge_docs(spark).filter("doc_id IS NULL OR doc_id <> 5")
    same = frames.words(80, 2).split()
    items = [(1, " ".join(same[5:40])), (2, "CAFÉ café"), (3, "café"), (10, "naïve-CAFé"), (4, ""), (5, None), (None, "a"),
             (7, frames.words(30, 9)), (7, frames.words(30, 9))]
    bench = frames.bench(spark, items)
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontam.contamination(docs, bench).collect()}
    brute = [(r[0], brute_hits(r[1], items)) for r in frames.edge_rows() if r[0] != 5]
    assert got == {(i, n, hit, tuple(found)) for i, (n, hit, found) in brute}
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(1 for r in frames.edge_rows() if r[0] != 5
                                and not brute_hits(r[1], items)[1])
    none = decontam.digest(decontam.contamination(docs, frames.bench(spark, []))).collect()
    assert {r.items_sha256 for r in none} == {hashlib.sha256(b"").hexdigest()}
    assert decontam.contamination(frames.no_docs(spark), bench).count() == 0


def test_hit_spans_lie_in_the_original_text(spark):
    text = "Zuerst: DER Hund, (der) läuft - heute noch; sehr weit fort!  Und dann?"
    r = decontam.contamination(frames.bench(spark, [(1, text)]).withColumnRenamed("item_id", "doc_id"),
                               frames.bench(spark, [(5, "hund der läuft heute noch")])).first()
    assert [text[s.start:s.end] for s in r.spans] == ["Hund, (der) läuft - heute noch"]


@pytest.mark.parametrize("max_words", [3, 40, 120])
def test_a_benchmark_over_the_limit_takes_several_automata(spark, max_words):
    docs = frames.edge_docs(spark).filter("doc_id IS NULL OR doc_id <> 5")
    same, long = frames.words(80, 2).split(), frames.words(60, 3)
    bench = frames.bench(spark, [(1, " ".join(same[5:40])), (2, long), (3, "café 東京"), (None, frames.words(50, 4)), (4, ""), (4, None)])
    key = lambda df: sorted(map(str, df.collect()))
    assert len(decontam._ranges(bench, decontam.WINDOW, max_words)) > 1
    assert key(decontam.contamination(docs, bench, max_words=max_words)) == key(decontam.contamination(docs, bench))
    assert key(decontam.clean(docs, bench, max_words=max_words)) == key(decontam.clean(docs, bench))


def test_items_without_an_id_contaminate(spark):
    import duckdb
    passage = frames.words(12, 77)
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, frames.words(30, 5)), (3, passage)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, frames.words(11, 6)), ("b", passage)], "item_id string, text string")
    got = decontam.digest(decontam.contamination(docs, bench))
    with duckdb.connect() as con:
        con.register("documents", docs.toPandas())
        con.register("benchmark", bench.toPandas())
        want = con.sql(queries.OP9_SQL).fetchall()
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == sorted(want)
    assert {r.doc_id: r.contaminated for r in got.collect()} == {1: True, 2: False, 3: True}
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [2]



def test_language_id(spark):
    rows = queries.QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    held = [r for r in rows if r.held_out and truth[r.doc_id] is not None]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)


def test_language_id_on_awkward_rows(spark):
    docs = frames.edge_docs(spark)
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 4}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.rejected for r in got)
    assert langid.identify(frames.no_docs(spark)).count() == 0
    unlabelled = docs.drop("lang").withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def _plain_languages(rows):
    """The classifier again, row by row: dictionaries, then the bytes of every chunk with each."""
    import zlib

    import regex
    import xxhash
    import zstandard
    letter = regex.compile(r"\p{L}")
    train = collections.defaultdict(list)
    for r in rows:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        if not held and r.lang is not None and r.text is not None and letter.search(r.text):
            train[r.lang].append(r.text)
    model = {}
    for lang, texts in train.items():
        hashes = {xxhash.xxh64_intdigest(t.encode(), seed=42): t for t in texts}
        signed = {h - 2 ** 64 if h >= 2 ** 63 else h: t for h, t in hashes.items()}
        buckets = collections.defaultdict(list)
        for h in sorted(signed):
            buckets[h % 64].append(h)
        chosen = sorted(h for b in buckets.values() for h in b[:8])
        model[lang] = b"\n".join(signed[h][:2000].lower().encode() for h in chosen)[:131072]
    order = sorted(model, key=lambda x: (-len(train[x]), x))

    def size(text, lang):
        data = text.lower().encode()
        raw = zstandard.ZstdCompressionDict(model[lang].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=6)
        coder = zstandard.ZstdCompressor(level=6, dict_data=raw, write_checksum=False, write_content_size=False,
                                         write_dict_id=False)
        return sum(len(coder.compress(data[i:i + 1024])) for i in range(0, len(data), 1024))

    out = []
    for r in rows:
        if r.text is None or not letter.search(r.text):
            out.append((r.doc_id, "und", 0.0))
            continue
        sizes = {x: size(r.text, x) for x in order}
        first, second = sorted(order, key=lambda x: (sizes[x], order.index(x)))[:2]
        out.append((r.doc_id, first, (sizes[second] - sizes[first]) / sizes[second]))
    return model, out


def test_language_id_against_plain_classifier(spark):
    docs = table(spark, SF_SMALL, "documents")
    model, want = _plain_languages(docs.collect())
    assert dict(langid.learn(docs)) == model
    got = [(r.doc_id, r.lang_pred, r.score) for r in queries.QUERIES["op6_language_id"](spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(want)
