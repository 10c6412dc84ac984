"""The pipeline: stages compose, decisions take effect, columns stay."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from listenlens.llm import huffman, langid, mixing, neardup
from listenlens.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm import frames


def test_every_query_is_registered():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_stages_against_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    cols, out = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out
        out = stage(spark, before, SF_SMALL).cache()
        assert out.columns == cols, name
        kept[name] = (before.collect(), out.collect())
    ids = lambda rows: sorted(r.doc_id for r in rows)

    before, after = kept["language_id"]
    rejected = {r.doc_id for r in langid.identify(docs).collect() if r.rejected}
    assert ids(after) == sorted(r.doc_id for r in before if r.doc_id not in rejected)

    before, after = kept["near_dedup"]
    from tests.llm.test_models import brute_classes
    frame = spark.createDataFrame(before, docs.schema)
    classes = brute_classes([(r.doc_id, r.text) for r in before], neardup.shingle_df(frame))
    assert ids(after) == sorted(i for (i, _), c in classes.items() if i == c)

    before, after = kept["decontamination"]
    from tests.llm.test_text_operators import brute_hits
    items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    clean = [r for r in before if not any_hit(r.text, items)]
    assert ids(after) == ids(clean)
    assert all(not brute_hits(r.text, items[:3])[1] for r in after[:20])

    before, after = kept["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before, docs.schema)).collect()}
    assert ids(after) == sorted(i for i, n in copies.items() for _ in range(n))

    t = Tokenizer.from_file(public_tokenizers.path(huffman.TOKENIZER))
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    want = sorted((r.doc_id, zlib.crc32(np.array(t.encode(r.text, add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in after)
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == want


def any_hit(text, items, window=10):
    """Does the text hold a window of an item?  By sets of joined windows."""
    from listenlens.llm.decontam import normal_words
    ws = normal_words(text)
    for size in {min(window, len(normal_words(t))) for _, t in items}:
        if size:
            wins = {b" ".join(x[j:j + size]) for _, t in items for x in [normal_words(t)] if min(window, len(x)) == size
                    for j in range(len(x) - size + 1)}
            if any(b" ".join(ws[j:j + size]) in wins for j in range(len(ws) - size + 1)):
                return True
    return False


def test_stages_take_awkward_rows(spark):
    docs = frames.edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == [f.name for f in frames.DOCS], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()
    docs = frames.no_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert docs.count() == 0
