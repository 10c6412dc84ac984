"""Fill-in-the-middle cuts against slicing by hand."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listenlens.llm import fim
from tests.llm import frames


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé東\U0001F600 \x00<P>"), max_size=60))
def test_index_converts_every_cut(text):
    index = fim.ExceptionIndex(np.frombuffer(text.encode(), dtype=np.uint8))
    points = np.arange(len(text) + 1)
    want = [len(text[:k].encode()) for k in points]
    assert index.to_bytes(points).tolist() == want
    assert index.to_points(np.array(want)).tolist() == points.tolist()
    assert len(index.lead) == sum(len(c.encode()) > 1 for c in text)


def brute(doc_id, text, rate=90, spm=20):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in fim.MARKS) or h3 % 100 >= rate:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < spm:
        return len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_awkward_rows_and_restored_texts(spark):
    rows = frames.edge_rows()
    marked = [(100 + i, t, *rows[0][2:]) for i, t in enumerate(["a <P> b", "x<S>", "<M>", "<P", "P>", "<<P", "é<" * 30, "\x00a" * 9] * 4)]
    docs = spark.createDataFrame(rows + marked, frames.DOCS)
    done = fim.transform(docs)
    assert set(docs.columns) <= {c for c in done.columns} | {"n"}
    got = done.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored().alias("back")).collect()
    assert len(got) == len(rows) + len(marked)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.digest(fim.transform(frames.no_docs(spark))).count() == 0


def test_rates_and_marks_are_parameters(spark):
    docs = frames.edge_docs(spark)
    marks = ("[pre]", "[suf]", "[mid]")
    done = fim.transform(docs, rate=100, spm=100, marks=marks)
    for r in done.select("text", "form", "output", fim.restored(marks).alias("back")).collect():
        assert r.form == ("spm" if r.text else "plain") and r.back == (r.text or "")
    assert {r.form for r in fim.transform(docs, rate=0).collect()} == {"plain"}
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("a", "ab", "c"), ("", "a", "b"), ("xx", "y", "z")[:2] + ("aba",)):
        with pytest.raises(ValueError):
            fim.transform(docs, marks=bad)
