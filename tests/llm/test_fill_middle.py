"""Fill-in-the-middle against a plain version, with pieces of every small size."""
import hashlib
import re

import pytest

from fleet_health.llm.fill_middle import _Reader, fill_in_middle, output_pieces
from llm_helpers import counted


def plain(doc_id, text, rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, sha(t), sha(t))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(t))


ODD = [(1, "a\nb\nc\nd<\nS>x<S\n>"), (2, "<P\n>\n<M\n<"), (3, "has <S> inside\nx"), (4, "\n\n\n"), (5, "no newline"), (6, None),
       (7, ""), (None, "id is null\nand two lines"), (None, None), (8, "é日本😀\n" * 40), (8, "é日本😀\n" * 40), (9, "long " * 60_000),
       (10, "x\n" * 50_000)] + [(100 + i, "\n".join("<PSM>"[j % 5] * (j % 4) for j in range(i))) for i in range(60)]


@pytest.mark.parametrize("piece_bytes", [1, 3, 1 << 16])
def test_equals_plain_version(spark, piece_bytes):
    rows = ODD if piece_bytes > 1 else [r for r in ODD if len(r[1] or "") < 1000]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert counted(fill_in_middle(df, piece_bytes=piece_bytes)) == counted([plain(*r) for r in rows])


@pytest.mark.parametrize("rate,spm", [(0, 50), (40, 0), (100, 100)])
def test_rates(spark, rate, spm):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    assert counted(fill_in_middle(df, rate=rate, spm=spm)) == counted([plain(*r, rate, spm) for r in ODD])


def test_text_ids_empty_table_and_clashing_names(spark, clashing, doc_rows, no_docs):
    df = spark.createDataFrame([("x", "a\nb"), ("", "c\nd\n"), (None, "e")], "doc_id string, text string")
    assert counted(fill_in_middle(df)) == counted([plain("x", "a\nb"), plain("", "c\nd\n"), plain(None, "e")])
    assert fill_in_middle(no_docs).count() == 0
    assert counted(fill_in_middle(clashing)) == counted([plain(d, t) for d, t, _ in doc_rows])


def test_one_shuffle_and_pieces_are_the_texts(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    plan = fill_in_middle(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    rows = {}
    for r in output_pieces(df, piece_bytes=7).collect():
        rows.setdefault(r.row, []).append((r.pos, r.piece, r.doc_id, r.form))
    for parts in rows.values():
        parts.sort(key=lambda p: p[0])
        text = b"".join(p[1] for p in parts[1:])
        assert max(len(p[1]) for p in parts[1:]) <= 10
        want = [plain(d, t) for d, t in ODD if d == parts[0][2]]
        assert hashlib.sha256(text).hexdigest() in {w[5] for w in want}


def test_reader_takes_any_cut():
    out = b"<P>a<S<S><<S<M>m<M"
    for k in range(1, len(out)):
        r = _Reader("psm")
        got = {}
        for i in range(0, len(out), k):
            for s, d in r.feed(out[i:i + k]):
                got[s] = got.get(s, b"") + d
        for s, d in r.end():
            got[s] = got.get(s, b"") + d
        assert got == {0: b"a<S", 2: b"<<S", 1: b"m<M"}
