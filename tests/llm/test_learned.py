import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import ROWS, SMALL

from townhall.llm import langid, quality, queries
from townhall.llm.common import rest


def held_out(doc_id, n, k):
    return zlib.crc32(str(doc_id).encode()) % n == k


def test_language_of_held_out_documents(spark, small):
    truth = {r["doc_id"]: r["lang"] for r in small.select("doc_id", "lang").collect()}
    rows = queries.op4_langid(spark, SMALL).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == held_out(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in own) >= 0.95 * len(own)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = langid.train(rng.integers(97, 123, (8, langid.WINDOW)).astype(np.uint8), np.full(8, 40), rng.integers(0, 2, 8), ["a", "b"])
    for p in (net.embed, *net.filters, *net.bias, net.out, net.out_bias):
        assert np.isfinite(p).all()
    x, n, y = rng.integers(97, 123, (4, langid.WINDOW)).astype(np.uint8), np.array([256, 30, 256, 3]), np.array([0, 1, 1, 0])
    net.embed, net.filters, net.out = net.embed.astype(float), [f.astype(float) for f in net.filters], net.out.astype(float)

    def loss():
        p = net.probabilities(x, n, net.tables())
        return -np.log(p[np.arange(4), y]).mean()

    grads = langid._gradients(net, x, n, y)
    for array, grad in ((net.embed, grads[0]), (net.filters[1], grads[2]), (net.out, grads[7])):
        flat, step = array.reshape(-1), 1e-6
        for k in np.argsort(-np.abs(grad).ravel())[:5]:
            old = flat[k]
            flat[k] = old + step
            up = loss()
            flat[k] = old - step
            down = loss()
            flat[k] = old
            assert (up - down) / (2 * step) == pytest.approx(grad.ravel()[k], rel=2e-2, abs=1e-5)


def test_windows_hold_the_whole_text():
    for n in (0, 1, 255, 256, 257, 509, 510, 5000):
        raw = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        x, size = langid.cut_windows(raw)
        step = langid.WINDOW - max(langid.WIDTHS) + 1
        assert all(x[k, : size[k]].tobytes() == raw[k * step : k * step + size[k]] for k in range(len(x)))
        for w in langid.WIDTHS:
            assert {raw[i : i + w] for i in range(n - w + 1)} <= {x[k, : size[k]].tobytes()[i : i + w] for k in range(len(x)) for i in range(size[k] - w + 1)}


def test_language_of_odd_rows(odd, empty):
    net = langid.fit(odd, langid.learnable())
    rows = langid.classify(odd, net).collect()
    assert len(rows) == len(ROWS)
    letterless = {6, 7, 8, 9}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in letterless)
    assert all(r["lang_pred"] in net.names for r in rows if r["doc_id"] in {1, 4, 5, 10, 11, 12})
    kept = langid.keep_known(odd, net, 0.0)
    assert kept.columns == odd.columns and kept.count() == sum(r["lang_pred"] != "und" for r in rows)
    assert langid.fit(empty, langid.learnable()) is None
    assert langid.classify(empty, net).count() == 0 and langid.keep_known(empty, None, 0.0).count() == 0
    assert {r["lang_pred"] for r in langid.classify(odd, None).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = queries.op6_quality(spark, SMALL).collect()
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    own = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in own if y == 1], [s for s, y in own if y == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.9


def test_score_is_the_dot_product_of_counts():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.3)
    x = quality.features(b"One two THREE two, 44 one two")
    assert len(x) == 2 * (7 + 6 + 5)
    z = 0.3 + sum(n / np.sqrt(len(x)) * float(model.weights[k]) for k, n in Counter(x.tolist()).items())
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-z)))
    assert model.score(quality.features(None)) == model.score(quality.features(b" ")) == pytest.approx(1 / (1 + np.exp(-0.3)))


def test_ftrl_separates_and_zeroes_noise():
    rng = np.random.default_rng(4)
    rows = [(np.array([int(y), 2 + int(rng.integers(5000))]), np.array([1.0, 1.0]), int(y)) for y in rng.integers(0, 2, 800)]
    model = quality.train(rows)
    assert model.weights[1] > 0.5 > -0.5 > model.weights[0]
    assert np.abs(model.weights[2:5002]).max() < 0.3 and (model.weights[6000:] == 0).all()


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 0), (9, None, 1), (None, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels, quality.learnable())
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (6, 7, 8)}) == 1
    assert quality.fit(odd, labels.limit(0), quality.learnable()) is None
    assert {r["score"] for r in quality.score(odd, None).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_split_is_the_stated_one(spark):
    from pyspark.sql import functions as F

    rows = spark.range(50).select("id", rest(F.col("id"), 4).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in rows)
