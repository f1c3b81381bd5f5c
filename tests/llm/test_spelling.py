"""The index against sorted suffixes, searches and groups against plain loops over all edits."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import SCHEMA

from townhall.llm import spelling as S


def edits(w, alphabet):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
    return out - {w}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def plain_vocabulary(rows, least=2):
    """rows: (doc_id, text)."""
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= least}


def plain(voc):
    alphabet = set("".join(voc))
    rows, form = {}, {}
    for w, n in voc.items():
        near = sorted((x for x in edits(w, alphabet) if x in voc), key=lambda x: (-voc[x], x))
        form[w] = near[0] if near and voc[near[0]] >= 10 * n else None
        rows[w] = [form[w], None, n, len(near), voc[near[0]] if form[w] else None]
    for w, row in rows.items():
        end = w
        while form[end]:
            end = form[end]
        row[1] = end
    return {w: tuple(r) for w, r in rows.items()}


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


WORD = st.text("abé", min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.sets(WORD, min_size=1, max_size=30), st.lists(WORD, max_size=8))
def test_search_finds_all_words_one_edit_away_that_share_the_end(words, more):
    words = sorted(words)
    index = S.Index(words)
    patterns = words + more + ["zz", "az"]
    exact = np.array([len(p) - len(p) // 2 for p in patterns])
    q, t = S.one_error(index, patterns, exact)
    found = {(int(a), words[b]) for a, b in zip(q, t, strict=True)}
    assert len(found) == len(q)
    expect = set()
    for k, p in enumerate(patterns):
        half = p[len(p) // 2 :]
        expect |= {(k, x) for x in edits(p, "abézxyw") & set(words) if x.endswith(half) and any(half == x[len(x) - len(half) :] for _ in [0]) and x[: len(x) - len(half)] != p[: len(p) - len(half)]}
    assert found == expect


def test_the_index_is_the_sorted_suffixes():
    words = sorted({"banana", "ananas", "nab", "é", "bananas", "an"})
    index = S.Index(words)
    text = [(k, w[i:]) for k, w in enumerate(words) for i in range(len(w) + 1)]
    order = sorted(range(len(text)), key=lambda i: ([*map(ord, text[i][1]), -1], text[i][0]))
    assert index.suffix.tolist() == order


def vocabulary_of(spark, voc):
    return spark.createDataFrame(list(voc.items()), "word string, n long")


def near_plain(voc):
    alphabet = set("".join(voc))
    out = {}
    for w in voc:
        near = sorted((x for x in edits(w, alphabet) if x in voc), key=lambda x: (-voc[x], x))
        if near:
            out[w] = (len(near), near[0], voc[near[0]])
    return out


@pytest.mark.parametrize("shard", [40_000, 60, 11])
def test_hot_halves_are_cut_into_pieces(spark, shard):
    rng = random.Random(3)
    voc = {}
    for _ in range(400):
        # A third of the words share length and left half.
        w = "common" + "".join(rng.choices("ab", k=6)) if rng.random() < 0.4 else "".join(rng.choices("abé", k=rng.choice([7, 8, 9])))
        voc[w] = rng.choice([2, 5, 60, 600])
    found = {r.word: (r.n_near, r.form, r.form_n) for r in S.near_words(vocabulary_of(spark, voc), shard).collect()}
    assert found == near_plain(voc)


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(9)] + [("x", "y"), ("x2", "y")], "word string, form string")
    found = {r.word: r.root for r in S.roots(forms).collect()}
    assert found == {**{f"w{k}": "w9" for k in range(9)}, "x": "y", "x2": "y"}


def test_whole_table_equals_plain_loops(small, texts):
    assert got(S.variants(small)) == plain(plain_vocabulary(texts.items()))


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(S.variants(odd, 1)) == plain(plain_vocabulary(rows, 1))
    assert got(S.variants(odd)) == plain(plain_vocabulary(rows))
    assert S.variants(empty).count() == 0


def test_ties_case_and_letters_outside_ascii(spark):
    words = {"striving": 40, "strivinx": 3, "strivina": 40, "ÉCRIRENT": 2, "Écrirent": 30, "éçrirent": 1, "aaaaaaaaaa": 30, "aaaaaaaaa": 2, "ab" * 300: 20, "ab" * 300 + "a": 2, "×÷×÷×÷×": 2}
    rows = [(k, " ".join([w] * n) + "1", "xx", "s", 1) for k, (w, n) in enumerate(words.items())]
    df = spark.createDataFrame(rows, SCHEMA)
    found = got(S.variants(df))
    assert found == plain(plain_vocabulary([(r[0], r[1]) for r in rows]))
    assert len(found) >= 9
