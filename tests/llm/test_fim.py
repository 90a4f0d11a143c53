"""Fill-in-middle: piece tables, forms and the way back, against a plain version over str."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vecspark.llm import fim


def plain_version(doc_id, text, seed=1):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, n, form, *((None, None) if form == "plain" else (len(p), len(m))), out, sha(out), sha(text))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    bits = ["abc", "X", " ", "\n", "é", "日本", "🙂", "<", "P", ">", "<S", "M>", "12", "\x00", "\r", "ß", "a" * 40]
    say = lambda n: "".join(rng.choice(bits) for _ in range(n))
    out = [(i, say(rng.randrange(0, 40))) for i in range(300)]
    out += [(1000, None), (1001, ""), (None, "no id here"), (None, None), (7, "same id"), (7, "same id"), (-5, "negative"),
            (1002, "a <P> b"), (1003, "<M>"), (1004, "x" * 50_000), (1005, say(60_000)), (1 << 40, say(9))]
    return out


@pytest.mark.parametrize("window,batch", [(1 << 20, 4 << 20), (64, 200), (1, 1)])
def test_transform_and_restore(spark, rows, monkeypatch, window, batch):
    if window == 1:
        rows = [r for r in rows if not r[1] or len(r[1]) < 1000]
    monkeypatch.setattr(fim, "WINDOW", window)
    monkeypatch.setattr(fim, "BATCH", batch)
    got = []
    import pyarrow as pa
    rb = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    for out in fim._transform("text", "doc_id", ["doc_id"], 1, 90, 20)([rb.slice(0, 5), rb.slice(5)]):
        back = [x for piece in fim._restore("fim_text", "fim_form", ["doc_id"])([out]) for x in piece.to_pylist()]
        assert len(back) == out.num_rows
        for a, b in zip(out.to_pylist(), back):
            assert hashlib.sha256(b["restored_text"].encode()).hexdigest() == b["restored_sha256"]
            got.append((a["doc_id"], a["fim_units"], a["fim_form"], a["fim_prefix_chars"], a["fim_middle_chars"], a["fim_text"],
                        a["fim_sha256"], b["restored_sha256"]))
    assert got == [plain_version(*r) for r in rows]


def test_on_spark_with_clashing_columns(spark, rows):
    docs = (spark.createDataFrame(rows, "doc_id long, text string").withColumn("FIM_text", F.lit(1)).withColumn("n", F.lit("mine"))
            .withColumn("restored_sha256", F.lit("x")).withColumn("form", F.lit("f")))
    out = fim.fim_transform(spark, docs)
    assert "n" in out.columns and "text" not in out.columns
    back = fim.fim_restore(spark, out)
    want = sorted((str(x[:5] + x[6:]) for x in (plain_version(*r) for r in rows)))
    assert sorted(str(tuple(r)) for r in fim.fim_digest(back).collect()) == want
    texts = {(r["doc_id"], r["restored_text"]) for r in back.select("doc_id", "restored_text").collect()}
    assert texts == {(i, t or "") for i, t in rows}
    assert fim.fim_digest(fim.fim_restore(spark, fim.fim_transform(spark, docs.limit(0)))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ<>PSM é\n1", max_size=30), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]))
def test_any_cut_comes_back(text, a, b, form):
    raw = text.encode()
    if any(s in raw for s in fim.SENTINELS):
        return
    a, b = sorted((min(a, len(raw)), min(b, len(raw))))
    out = bytes(fim.transformed(raw, a, b, form))
    assert len(out) == len(raw) + 9 and bytes(fim.restored(out, form)) == raw


def test_foreign_texts_fail():
    for bad in (b"abc", b"x<P>a<S>b<M>c", b"<P>a<M>c"):
        with pytest.raises(ValueError):
            fim.restored(bad, "psm")
    with pytest.raises(ValueError):
        fim.PieceTable((b"ab",), [(0, 0, 2)]).cut(3)
    assert np.array_equal(fim._unit_starts(np.frombuffer("ab1é c".encode(), np.uint8), np.zeros(0, int)), [0, 2, 3, 5, 6])
