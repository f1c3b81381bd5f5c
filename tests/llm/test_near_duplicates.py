import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from odd_rows import ROWS

from townhall.llm import near_copies, simhash, suffix_dedup


def plain_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_groups(prints):
    """Least id reachable over links of three bits or fewer; prints is a list of (id, fingerprint)."""
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = defaultdict(lambda: None)
    for (d, _), g in zip(prints, group, strict=True):
        if d is not None and (least[g] is None or d < least[g]):
            least[g] = d
    return [least[g] for g in group]


def test_groups_match_a_comparison_of_all(small, texts):
    rows = simhash.groups(small).collect()
    prints = [(d, plain_print(t)) for d, t in sorted(texts.items())]
    want = dict(zip([d for d, _ in prints], zip([f for _, f in prints], plain_groups(prints), strict=True), strict=True))
    assert {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in rows} == want


def test_links_find_every_close_pair_across_large_cells(spark, monkeypatch):
    # Blocks of four owners: cells are cut, as a huge group would be.
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(12):
            near = base
            for _ in range(rng.randint(1, 4)):
                near ^= 1 << rng.randrange(64)
            prints.add(near)
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    pairs = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    parent = {s: s for s in signed}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for r in pairs:
        assert ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 3
        parent[root(r["a"])] = root(r["b"])
    want = plain_groups(list(zip(signed, prints, strict=True)))
    got = Counter(map(frozenset, group_by(signed, [root(s) for s in signed])))
    assert got == Counter(map(frozenset, group_by(signed, want)))


def group_by(items, keys):
    out = defaultdict(set)
    for i, k in zip(items, keys, strict=True):
        out[k].add(i)
    return out.values()


def test_stars_of_a_block_connect_it():
    own = np.array([0, 1, 3, 7, 1 << 40, 0xFFFF << 20], np.uint64)
    both = np.concatenate([own, np.array([15, 31, (1 << 40) | 1], np.uint64)])
    found = [(int(a), int(b)) for x, y in simhash.link_block(own, both) for a, b in zip(x, y, strict=True) if a != b]
    want = plain_groups([(int(p), int(p)) for p in both])
    group = dict(zip(map(int, both), want, strict=True))
    assert all(group[a] == group[b] for a, b in found) and len(found) <= len(own) + len(both)
    assert {a for a, _ in found} | {b for _, b in found} == {p for p in group if list(group.values()).count(group[p]) > 1}


def test_groups_and_stage_of_odd_rows(odd, empty):
    rows = simhash.groups(odd).collect()
    want = [(d, plain_print(t)) for d, t, *_ in ROWS]
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows) == Counter((d, f, g) for (d, f), g in zip(want, plain_groups(want), strict=True))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(plain_groups(want)))
    assert simhash.groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def plain_similar(texts, least=0.8):
    """Least id reachable over pairs whose five-word shingles have a Jaccard similarity of at least 0.8."""
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and group[a] != group[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    return group


@pytest.mark.parametrize("crowd", [(16, 32), (0, 2)])
def test_edited_copies_link_by_their_shingles(spark, monkeypatch, crowd):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    line = "this line of nine words is in many documents"
    texts = []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 160))] + line.split()
        texts.append(" ".join(base))
        for k in range(6):
            # Up to a twentieth of the words changed: on both sides of the threshold.
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy[: len(copy) - k % 3]))
    texts += [None, "", "one", "One", "two words", "two words", "a b c d e", line, line]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_similar(rows)
    for name, value in zip(("CROWD", "CENTRES"), crowd, strict=True):
        monkeypatch.setattr(near_copies, name, value)  # every place is crowded
    assert {r["doc_id"]: r["component_id"] for r in near_copies.groups(docs).collect()} == want
    found = {r["doc_id"]: r["component_id"] for r in simhash.groups(docs).collect()}
    assert len(set(want.values())) < len(set(found.values()))  # what three bits leave


def test_a_dense_group_around_the_threshold(spark, monkeypatch):
    """Copies of one text with edits of their own: all places are crowded in any order, about half of the pairs are similar."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    monkeypatch.setattr(near_copies, "CROWD", 2)
    monkeypatch.setattr(near_copies, "CENTRES", 6)
    found = near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_similar(rows)


def test_links_of_fingerprints_join_sets_before_their_prefixes_do(spark, monkeypatch):
    rng = random.Random(6)

    def five(text):
        return simhash.majority(near_copies.shingles(text.encode(), 5))

    long = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    near = next(t for t in (" ".join([*long, f"x{k}"]) for k in range(10**4)) if (five(t) ^ five(" ".join(long))).bit_count() <= 3)
    texts = [" ".join(long), near, " ".join(f"w{rng.randrange(10**6)}" for _ in range(600)), "a b c d e f", "f e d c b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "links", lambda docs, sets, rows, words, share, label: label)  # no prefixes
    assert {r["doc_id"]: r["component_id"] for r in near_copies.groups(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    # Fingerprints that link say nothing yet: the sets are compared.
    monkeypatch.setattr(simhash, "majority", lambda h: 7)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.groups(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_a_dense_group_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    """Copies that share most shingles, but too few: 1770 pairs meet, and hardly any is handed on to be compared."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(60):
        copy = list(base)
        for place in rng.sample(range(1, 14), 3):
            copy[10 * place + rng.randrange(5)] = f"x{k}.{place}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    seen, real = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda docs, sets, pairs, words, share: seen.append(pairs.count()) or real(docs, sets, pairs, words, share))
    found = near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_similar(rows)
    assert sum(seen) < 300


def test_short_sketches_refuse_no_similar_pair():
    rng, refused = np.random.default_rng(4), 0
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.5, 1)], rng.integers(0, 2**63, rng.integers(0, 1 + n // 4)).astype(np.uint64)]))
        bits = sum(((int(x) ^ int(y)) & (2**64 - 1)).bit_count() for x, y in zip(near_copies.fold(a), near_copies.fold(b), strict=True))
        ok = 9 * bits <= len(a) + len(b)
        assert ok or not near_copies.similar(a, b, near_copies._share(0.8))
        refused += not ok
    assert refused > 30


def test_sketches_refuse_no_similar_pair():
    rng, share = np.random.default_rng(3), near_copies._share(0.8)
    refused = 0
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.5, 1)], rng.integers(0, 2**63, rng.integers(0, 1 + n // 4)).astype(np.uint64)]))
        ok = near_copies.may_be_similar(near_copies.sketch(a), near_copies.sketch(b), len(a), len(b), share)
        assert ok or not near_copies.similar(a, b, share)
        refused += not ok
    assert refused > 50


def test_near_copies_of_odd_rows(odd, empty):
    kept = simhash.keep_one(odd, near_copies.groups(odd))
    assert kept.columns == odd.columns and near_copies.groups(odd).count() == len(ROWS)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 4, 5, 6, 9, 10, 11, 12, 13]
    assert near_copies.groups(empty).count() == 0


def plain_removed(texts):
    """Removed bytes by a dictionary of all 400-byte strings."""
    seen = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        out.append(bytes(gone))
    return out


def compare(spark, texts):
    rows = suffix_dedup.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    raw = [(t or "").encode() for t in texts]
    for r, gone in zip(sorted(rows, key=lambda r: r["doc_id"]), plain_removed(raw), strict=True):
        text = raw[r["doc_id"]]
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(text), sum(gone), spans, kept)


def test_repeats_match_a_dictionary_of_all_strings(spark):
    rng = random.Random(9)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    passage, line = noise(700), noise(150)
    texts = [None, "", "x" * 399, "x" * 400, "x" * 401, noise(500), "ab" * 600]
    for k in (399, 400, 401, 450, 700):
        texts += [noise(rng.randint(0, 300)) + passage[:k] + noise(rng.randint(0, 300)) for _ in range(2)]
    texts += [line.join(noise(100) for _ in range(8)), line.join(noise(90) for _ in range(8)), noise(40) + texts[5] + noise(40)]
    for _ in range(6):
        edited = list(passage)
        for _ in range(2):
            edited[rng.randrange(len(edited))] = "#"
        texts.append(noise(50) + "".join(edited) + noise(50))
    compare(spark, texts)


def test_repeats_across_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_made", [suffix_dedup._Hash(f, s, 4096) for f, s in ((0x9E3779B97F4A7C15, 1), (0xD1342543DE82EF95, 2))])
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 101, 3000, dtype=np.uint8)
    whole = list(suffix_dedup.members(raw, True))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    parts = list(suffix_dedup.members(raw, True))
    covered = [p for lo, hi in ((x[1], x[2]) for x in parts) for a, b in zip(lo, hi, strict=True) for p in range(a, b + 1)]
    assert covered == list(range(len(raw) - 399))
    of = {p: a for x in whole for a, lo, hi in zip(*x[:3], strict=True) for p in range(lo, hi + 1)}
    assert all(of[p] == a for x in parts for a, lo, hi in zip(*x[:3], strict=True) for p in range(lo, hi + 1))


def test_repeats_of_odd_rows(odd, empty):
    rows = suffix_dedup.remove(odd).collect()
    assert len(rows) == len(ROWS)
    gone = plain_removed([(t or "").encode() for _, t, *_ in ROWS])
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in rows) == Counter((d, len(g), sum(g)) for (d, *_), g in zip(ROWS, gone, strict=True))
    assert suffix_dedup.remove(empty).count() == 0
