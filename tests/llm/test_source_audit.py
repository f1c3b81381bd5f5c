"""Terms by pointer sort against a regular expression, and the audit against plain loops."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import SCHEMA

from townhall.llm import source_audit as S

WORDS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def terms(t):
    return WORDS.findall(lower(t or ""))


def plain(rows, min_docs=10, top=10):
    """rows: (lang, source, text)."""
    rows = [(a or "", b or "", terms(t)) for a, b, t in rows]
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), {(a, b) for a, b, _ in rows}
    for a, b, w in rows:
        docs[a].update(set(w))
        n[a, b].update(w)
    out = []
    for a, b in groups:
        kept = [t for t, k in docs[a].items() if k >= min_docs]
        price = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = price(n[a, b])
        f = lambda x, y: (x - y) ** 2 // (x + y)
        q = price(sum((n[g] for g in groups if g[0] == a), Counter()))
        pairs = [(sum(f(p[t], o[t]) for t in kept), s) for l, s in groups if l == a and s != b for o in [price(n[l, s])]]
        own = [(f(p[t], q[t]), t) for t in kept if n[a, b][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", own, top)):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(a, b, part, item, v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def got(df, **args):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in S.audit(df, **args).collect())


def split(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    return S._LOWER[np.frombuffer(b"".join(raw), np.uint8)], offsets


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abAB é漢0 -ß", max_size=40), max_size=12), st.sampled_from([2, 2048]))
def test_pointers_are_the_words_in_order(texts, small):
    data, offsets = split(texts)
    expect = [w.encode() for t in texts for w in terms(t)]
    starts, lengths = S.word_pointers(data, offsets)
    assert [data[s : s + k].tobytes() for s, k in zip(starts, lengths)] == expect


def test_equal_runs_are_sorted_terms(monkeypatch):
    rng = np.random.default_rng(5)
    stems = ["starting", "start", "startings", "startingsoon", "startingsoon" * 4, "a", "é", "z" * 8, "z" * 16, "z" * 17]
    texts = [" ".join(stems[k] + "xyz"[j] * m for k, j, m in zip(rng.integers(0, 10, 400), rng.integers(0, 3, 400), rng.integers(0, 3, 400))) for _ in range(20)]
    data, offsets = split(texts)
    starts, lengths = S.word_pointers(data, offsets)
    expect = sorted(Counter(w.encode() for t in texts for w in terms(t)).items())
    for small in (2048, 600, 100):
        monkeypatch.setattr(S, "SMALL", small)
        order, runs = S.equal_runs(data, starts, lengths)
        words = [data[starts[k] : starts[k] + lengths[k]].tobytes() for k in order]
        assert words == sorted(words)
        assert [(words[a], b - a) for a, b in zip(runs, [*runs[1:], len(words)])] == expect


def test_long_text_is_counted_piece_by_piece(monkeypatch):
    text = "one two three " * 50 + "x" * 300 + " two one" * 30
    monkeypatch.setattr(S, "SLICE", 64)
    assert S._long_text(split([text])[0]) == {k.encode(): v for k, v in Counter(terms(text)).items()}


@pytest.mark.parametrize("tile", [(128, 4096), (2, 7)])
def test_whole_table_equals_plain_loops(small, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE_SOURCES", tile[0])
    monkeypatch.setattr(S, "TILE_TERMS", tile[1])
    rows = [(r.lang, r.source, r.text) for r in small.collect()]
    assert got(small) == plain(rows)


def test_odd_rows(odd, empty):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    for args in ({"min_docs": 1}, {"min_docs": 2, "top": 1}, {}):
        assert got(odd, **args) == plain(rows, **args)
    assert any(r[:2] == ("", "") for r in got(odd))
    assert S.audit(empty).count() == 0


def test_ties_follow_the_bytes_of_the_item(spark):
    rows = [(k, "Zed é zed ﬀ 😀 b a", "xx", s, 1) for k in range(12) for s in ("s", "t", None)] + [(99, "q", "xx", "r", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plain([(r[2], r[3], r[1]) for r in rows])
