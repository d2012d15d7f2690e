"""Exact dedup and line dedup against brute force."""
import hashlib
import re
from collections import defaultdict

import pytest

from fleet_health.llm.exact_dedup import exact_duplicates
from fleet_health.llm.line_dedup import drop_repeated_lines

from llm_helpers import counted

COLS = ["doc_id", "keep_id", "group_size", "text_sha256"]


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((d, t or ""))
    out = []
    for h, g in groups.items():
        keep = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        out += [(d, keep, len(g), h) for d, _ in g]
    return out


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_duplicates(docs, doc_rows, fan_in):
    got = exact_duplicates(docs, fan_in=fan_in)
    assert counted(got.select(*COLS)) == counted(brute_exact(doc_rows))
    kept = got.filter("kept")
    assert kept.count() == kept.select("text_sha256").distinct().count() == got.select("text_sha256").distinct().count()
    assert kept.filter("not (doc_id <=> keep_id)").count() == 0


def test_exact_odd_tables(clashing, doc_rows, no_docs):
    assert counted(exact_duplicates(clashing).select(*COLS)) == counted(brute_exact(doc_rows))
    assert exact_duplicates(no_docs).count() == 0


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows):
    owner = {}
    for d, t, _ in rows:
        for k in map(key_of, (t or "").split("\n")):
            if k not in owner or (d is not None and (owner[k] is None or d < owner[k])):
                owner[k] = d
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < 10 or owner[key_of(x)] == d]
        out.append((d, "\n".join(kept) if len(kept) < len(lines) else t, len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (3, 2), (7, 3)])
def test_lines(docs, doc_rows, batches, fan_out):
    got = drop_repeated_lines(docs, batches=batches, fan_out=fan_out)
    assert counted(got.select("doc_id", "text", "n_lines", "n_dropped")) == counted(brute_lines(doc_rows))
    assert got.filter("n_dropped > 0 and n_chars != length(text)").count() == 0


def test_lines_odd_tables(clashing, doc_rows, no_docs):
    got = drop_repeated_lines(clashing)
    assert sorted(got.columns) == sorted([*clashing.columns, "n_dropped"])
    assert counted(got.select("doc_id", "text", "n_lines", "n_dropped")) == counted(brute_lines(doc_rows))
    assert got.select("key", "hash", "own").distinct().count() == 1
    assert drop_repeated_lines(no_docs).count() == 0
