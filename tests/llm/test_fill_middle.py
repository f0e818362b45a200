"""Fill-in-middle against a plain version, its kernel on awkward bytes, and its inverse."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litsieve.llm import fill_middle as M
from tests.llm import cases


def plainly(doc_id, text, seed=1):
    """n, form, prefix, middle, output by slicing."""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in M.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def units_of(text, unit):
    """Units one after another."""
    out = []
    for before, c in zip(" " + text, text):
        begins = {"char": True, "word": before in " \t\n\v\f\r" and c not in " \t\n\v\f\r", "line": before == "\n"}[unit]
        if begins or not out:
            out.append("")
        out[-1] += c
    return out


@pytest.mark.parametrize("unit", sorted(M.UNITS))
@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_units(unit, block):
    r = random.Random(block)
    texts = ["".join(r.choice("ab \n\tß漢😀é") for _ in range(r.choice([0, 0, 1, 2, 9, 40]))) for _ in range(120)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    index = M.UnitIndex(np.frombuffer(b"".join(raw), np.uint8), offsets, unit, block)
    want = [units_of(t, unit) for t in texts]
    assert index.counts.tolist() == [len(w) for w in want]
    wanted = np.sort(np.array([[r.randint(0, len(w)) for _ in range(2)] for w in want]), axis=1)
    at = [[offsets[d] + len("".join(w[:k]).encode()) for k in wanted[d]] for d, w in enumerate(want)]
    assert index.bytes_at(wanted).tolist() == at


def test_no_text_at_all():
    index = M.UnitIndex(np.zeros(0, np.uint8), np.zeros(4, np.int64))
    assert index.counts.tolist() == [0, 0, 0] and index.bytes_at(np.zeros((3, 2), np.int64)).tolist() == [[0, 0]] * 3


def test_awkward(spark):
    rows = cases.DOCS + [(100 + k, t, None, None) for k, t in enumerate(["<", "<P", "x<P>y", "<<S><", "a<M", ">", "P>" * 50, "<" * 50, "😀", "\n"] * 8)]
    made = M.fill_in_middle(cases.docs(spark, rows), block_bytes=1 << 12)
    got = made.select("doc_id", "n", "form", "prefix_units", "middle_units", "output", M.restored(F.col("output"), F.col("form")).alias("again")).collect()
    want = [(d, *plainly(d, t), t or "") for d, t, *_ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(cases.empty(spark)).count() == 0


def test_words_and_lines(spark):
    rows = [(k, "one two\nthree  four\n\nfive " * (k % 5), None, None) for k in range(60)]
    for unit in ("word", "line"):
        sentinels = ("[pre]", "[suf]", "[mid]")
        made = M.fill_in_middle(cases.docs(spark, rows), unit=unit, sentinels=sentinels, seed=7, plain_percent=0, spm_percent=50)
        got = {r.doc_id: r for r in made.withColumn("again", M.restored(F.col("output"), F.col("form"), sentinels)).collect()}
        for doc_id, text, *_ in rows:
            parts, row = units_of(text, unit), got[doc_id]
            assert row.n == len(parts) and row.again == text
            if row.form != "plain":
                prefix, middle = "".join(parts[: row.prefix_units]), "".join(parts[row.prefix_units : row.prefix_units + row.middle_units])
                assert f"[pre]{prefix}" in row.output and row.output.endswith(f"[mid]{middle}")
    with pytest.raises(ValueError, match="units are"):
        M.fill_in_middle(cases.empty(spark), unit="byte")


def test_partitions_do_not_matter(spark, sf):
    docs = cases.documents(sf, spark)
    one, many = (M.fill_in_middle(docs.repartition(k)).collect() for k in (1, 9))
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(tuple(r) == (r.doc_id, *plainly(r.doc_id, texts[r.doc_id])) for r in one)
