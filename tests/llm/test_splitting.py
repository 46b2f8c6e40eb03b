import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spoolwright.llm import splitting as sp
from spoolwright.llm.tokens import tokenizer

T = tokenizer()


def check(text, cut, limit, overlap):
    n = T.count(text)
    if n <= limit:
        assert len(cut) == (1 if text else 0)
        return
    assert len(cut) > 1 and cut[0][0] == 0 and cut[-1][1] == len(text)
    for a, b, n, _ in cut:
        assert n == T.count(text[a:b]) <= limit and a < b
    for (a, b, _, _), (c, d, _, _) in zip(cut, cut[1:]):
        assert a < c <= b < d
        if overlap and c < b:
            assert T.count(text[c:b]) >= min(overlap, 1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.data())
def test_range_maximum(n, data):
    strengths = np.array(data.draw(st.lists(st.integers(0, 6), min_size=n, max_size=n)))
    table = sp.StrongestCut(strengths, n)
    for _ in range(20):
        lo = data.draw(st.integers(0, n - 1))
        hi = data.draw(st.integers(lo, n - 1))
        top = strengths[lo : hi + 1].max()
        assert table.best(lo, hi) == max(k for k in range(lo, hi + 1) if strengths[k] == top)


def test_prefers_the_strongest():
    line = "some words of a line that goes on\n"
    text = line * 8 + "diff --git a/x b/x\n" + line * 2 + "@@ -1 +1 @@\n" + line * 3 + "\n" + line * 30
    cut = sp.pieces(text, T, 120, 10)
    check(text, cut, 120, 10)
    assert text[cut[0][1] :].startswith("diff --git") and cut[0][3] == sp.FILE
    later = [k for _, _, _, k in cut[1:-1]]
    assert set(later) <= {sp.HUNK, sp.PARAGRAPH, sp.LINE}


def test_boundaries():
    text = "a b. c\r\n\r\nd\n@@ x\ndiff --git q\ne"
    got = {text[k:][:4]: sp.STRENGTH_NAMES[v] for k, v in sp.boundaries(text).items()}
    assert got == {" c\r\n": "sentence", "\r\nd\n": "line", "d\n@@": "paragraph", "@@ x": "hunk", "diff": "file", "e": "line"}


@pytest.mark.parametrize(
    "text",
    ["word " * 3000, "x" * 20_000, "\n" * 9000, "и" * 9000, "á👩‍👩‍👧" * 2000, "end. " * 900 + "\r\n" * 500, "'" * 5000 + "s" * 50, "　 \t" * 3000, "日本語。" * 2500],
)
@pytest.mark.parametrize("limit,overlap", [(400, 30), (64, 0), (1000, 128)])
def test_texts(text, limit, overlap):
    check(text, sp.pieces(text, T, limit, overlap), limit, overlap)


@pytest.mark.parametrize("text", [" " * 600_000, "a\n" + "\n" * 300_000 + "b", "x" + " \t" * 200_000])
def test_very_long_blanks(text):
    cut = sp.pieces(text, T)
    assert len(cut) > 1 and all(n <= 4096 for _, _, n, _ in cut) and cut[-1][1] == len(text)


def test_both_ways_of_counting_agree():
    for text in (" " * 10_000 + "x  y", "q\n" * 3 + "\t" * 12_000 + "z", "a b\n" + " " * 11_000 + "\nc 'd 's"):
        assert T.count(text) == len(T.encoding.encode_ordinary(text))


def test_overlap_is_as_told():
    text = "plain words and nothing else here " * 600
    cut = sp.pieces(text, T, 500, 60)
    check(text, cut, 500, 60)
    assert all(T.count(text[c:b]) == 60 for (_, b, _, _), (c, _, _, _) in zip(cut, cut[1:]))


@pytest.mark.parametrize(
    "text",
    ["\n" * 9000, "a b\n\n" * 2000, "code here \n\n    " * 1500, " \t\r\n" * 3000, "x\n \n" * 3000, "x" * 20_000, "и" * 9000, "word" + "\n" * 700 + "end. " * 900],
)
@pytest.mark.parametrize("limit,overlap", [(400, 30), (1000, 128), (4096, 128), (400, 190)])
def test_overlap_is_counted_in_the_text(text, limit, overlap):
    cut = sp.pieces(text, T, limit, overlap)
    check(text, cut, limit, overlap)
    assert all(T.count(text[c:b]) >= overlap for (_, b, _, _), (c, _, _, _) in zip(cut, cut[1:]))


def test_overlap_of_documents(sf):
    for r in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").to_pylist():
        cut = sp.pieces(r or "", T, 512, 128)
        check(r or "", cut, 512, 128)
        assert all(T.count(r[c:b]) >= 128 for (_, b, _, _), (c, _, _, _) in zip(cut, cut[1:]))


def test_stretches(monkeypatch):
    text = "one two. three\n" * 2000
    whole = sp.pieces(text, T, 100, 10)
    monkeypatch.setattr(sp, "STRETCH", 1)
    assert sp.pieces(text, T, 100, 10) == whole


def test_frame(spark):
    long = "line of text\n" * 3000
    df = spark.createDataFrame([(1, long, "x", 0), (2, "short", "x", 0), (3, None, "x", 0), (4, "", "x", 0), (1, long, "x", 0)], "doc_id bigint, text string, piece string, start int")
    rows = sp.split_documents(df).collect()
    assert {r.doc_id for r in rows} == {1} and len(rows) == 2 * len({r.piece for r in rows})
    for r in rows:
        assert r.text == long[r.start : r.stop] and r.n_tokens <= 4096
    assert sp.split_documents(df.limit(0)).collect() == []


def test_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sp.split_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r.doc_id for r in rows} == {d for d, t in docs.items() if T.count(t or "") > 4096}
    for d in {r.doc_id for r in rows}:
        cut = [(r.start, r.stop, r.n_tokens, 0) for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)]
        check(docs[d], cut, 4096, 128)
