"""Fill-in-the-middle against a plain version of it, text by text."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import fill_in_middle as fim
from lodestone.llm import queries as Q
from tests.oracle import both

TEXTS = [None, "", " ", "\n\t ", "a", " a", "a ", "a b  c\td\n", "wörd ß 日本 😀 x", "has <P> inside", "<M>", "<P", "S> <", "a <P<S", "x" * 70_000, "é " * 40_000, "same again", "same again", "\x1c a\x85b \xa0c"]


def plain(key, text, seed=42, fim_percent=50, spm_percent=80):
    text = text or ""
    hexed = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    parts = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(parts)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    return n, form, len(x), len(y), f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"


def test_every_text_and_the_way_back(spark):
    rows = [(i if i % 7 else None, t, f"{i}") for i, t in enumerate(TEXTS * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v0 string")
    coded = fim.transform(docs)
    assert coded.columns == ["doc_id", "v0", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = fim.restore(coded, keep=["doc_id", "v0", "n", "form", "prefix_chars", "middle_chars", "output"]).collect()
    assert len(found) == len(rows)
    of = {v: (k, t) for k, t, v in rows}
    for r in found:
        key, text = of[r["v0"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(key, text)
        assert r["restored"] == (text or "")
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_query_gives_what_sql_gives(spark):
    mine, theirs = both(spark, Q.op13_fill_in_middle, Q.ORACLES["op13_fill_in_middle"], "/root/testdata/sf0.001")
    assert mine == theirs


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("<>PSM ab\té😀\n"), max_size=12), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=8), st.sampled_from([0, 50, 100]), st.sampled_from([4, 1 << 22]))
def test_kernel_on_any_texts(rows, spm, block):
    raw = [t.encode() for t, _, _ in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h = np.array([(a, b, 0, a % 100) for _, a, b in rows], np.int64)
    was, fim.GATHER_BYTES = fim.GATHER_BYTES, block
    try:
        n, form, _, _, out, bounds = fim.rearranged(data, offsets, h, 50, spm)
        back, ends, good = fim.restored(out, bounds, form)
    finally:
        fim.GATHER_BYTES = was
    assert good.all() and back.tobytes() == data.tobytes() and (ends == offsets).all()
    for i, (t, a, b) in enumerate(rows):
        parts = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        assert n[i] == len(parts)
        if form[i]:
            x, y = sorted((a % (len(parts) + 1), b % (len(parts) + 1)))
            p, m, s = "".join(parts[:x]), "".join(parts[x:y]), "".join(parts[y:])
            want = f"<P>{p}<S>{s}<M>{m}" if form[i] == 1 else f"<S>{s}<P>{p}<M>{m}"
            assert out[bounds[i] : bounds[i + 1]].tobytes().decode() == want


def test_what_cannot_be_restored_is_null_and_empty_tables_stay_empty(spark):
    rows = [("abc", "psm"), ("<P>a<S>b", "psm"), ("<S>a<P>b<M>c", "psm"), ("<P>a<S>b<M>c<M>", "psm"), ("x<P>a<S>b<M>c", "psm"), (None, "plain"), ("a", None), ("a", "odd"), ("<S>a<P>b<M>c", "spm"), ("<P>", "plain")]
    found = fim.restore(spark.createDataFrame(rows, "output string, form string"), keep=["output"]).collect()
    assert [r["restored"] for r in found] == [None] * 8 + ["bca", "<P>"]
    none = spark.createDataFrame([], "doc_id long, text string, FORM int")
    assert fim.transform(none).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and fim.transform(none).count() == 0


@pytest.mark.parametrize("name", ["k0", "v0", "_text", "h1", "restored", "n"])
def test_names_that_clash(spark, name):
    docs = spark.createDataFrame([(1, "a b c", "x")], f"doc_id long, text string, `{name}` string")
    row = fim.restore(fim.transform(docs)).first()
    assert row["restored"] == "a b c" and row["n"] == 3
