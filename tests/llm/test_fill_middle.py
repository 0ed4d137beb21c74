import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm import fill_middle as M
from furrow.llm.queries import QUERIES
from small_tables import SF


def numbers(doc_id):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def plainly(text, h):
    """Form, number of units, prefix, middle and output, the slow way."""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in M.MARKS) or h[2] % 100 >= 90:
        return "plain", n, None, None, text
    if h[3] % 100 < 20:
        return "spm", n, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", n, len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["<P>", "a<S>b", "<M", "<<<", "a<P", "S>b", "M>", "P>x<", "<P<S<M", "a-b c\n\r\0d", "é́🙂ab", "abc", " ", "<p>"]


def test_odd_rows(spark, table_of, odd_rows):
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(ODD * 20)]
    got = M.restore(M.fill_middle(table_of(rows)), text="back").collect()
    want = sorted(map(str, [(i, *plainly(t or "", numbers(i)), t or "") for i, t in rows]))
    assert sorted(map(str, [(r.id, r.form, r.n, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got])) == want
    assert {r.form for r in got} == set(M.FORMS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("<>PSMab é🙂\n", max_size=12), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4)), max_size=8))
def test_any_batch(rows):
    """Neighbours in a batch do not touch each other, whatever their ends are."""
    bodies = [t.encode() for t, _ in rows]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in bodies]))).astype(np.int64)
    marks = M.checked(M.MARKS)
    h = [np.array([x[k] for _, x in rows], np.int64) for k in range(4)]
    out, places, n, form, prefix, middle = M.rearranged(data, offsets, h, marks)
    back, back_offsets = M.restored(out, places, form, marks)
    for k, (text, x) in enumerate(rows):
        want = plainly(text, x)
        assert (M.FORMS[form[k]], n[k], out[places[k] : places[k + 1]].tobytes().decode()) == (want[0], want[1], want[4])
        assert want[2] is None or (prefix[k], middle[k]) == want[2:4]
        assert back[back_offsets[k] : back_offsets[k + 1]].tobytes() == bodies[k]


def test_other_marks_and_columns(spark):
    marks = ("<pre>", "<suf>", "<mid>")
    docs = spark.createDataFrame([(i, "one <P> two " * i, "x") for i in range(60)], "doc_id long, text string, output string")
    rows = M.fill_middle(docs, marks=marks).withColumn("text", M.F.lit("old")).withColumn("c0", M.F.lit(None).cast("int"))
    got = M.restore(rows, marks=marks)
    assert got.columns == [*[c for c in rows.columns if c != "text"], "text"]
    assert {r.id: r.text for r in got.collect()} == {i: "one <P> two " * i for i in range(60)}
    for bad in (("<a>", "<a>", "<b>"), ("a", "<b>", "<c>"), ("<a>", "<bb>", "<c>"), ("<a>>", "<bb>", "<cc>")):
        with pytest.raises(ValueError):
            M.fill_middle(docs, marks=bad)


def test_long_text_and_empty_table(spark, table_of):
    long = "Wort für Wort. " * 300_000
    got = M.restore(M.fill_middle(table_of([(1, long), (2, "a"), (3, long)])), text="back").collect()
    assert {(r.id, r.output == plainly(long if r.id != 2 else "a", numbers(r.id))[4], r.back == (long if r.id != 2 else "a")) for r in got} == {(i, True, True) for i in (1, 2, 3)}
    assert M.restore(M.fill_middle(table_of([]))).count() == 0


def test_registered(spark):
    got = QUERIES["op13_fill_middle"](spark, SF)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {i: (*plainly(t, numbers(i)), t) for i, t in docs.items()}
    assert {tuple(r) for r in got.collect()} == {(i, w[1], w[0], w[2], w[3], digest(w[4]), digest(w[5])) for i, w in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
