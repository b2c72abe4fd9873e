import zlib

import numpy as np
import pytest

from quarryline.llm import language, queries


def test_gradients():
    n = language.Network(["a", "b", "c"], 4, 1)
    for d in (n.ahead, n.behind):
        d.table, d.gates, d.inner = (p.astype(float) for p in d.parameters())
    n.out, n.bias = n.out.astype(float), n.bias.astype(float)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 20, (7, 5)), rng.integers(0, 3, 5)
    x[4:, 1] = x[2:, 3] = 256
    _, grads = n.step(x, y)
    for p, g in zip(n.parameters(), grads):
        j = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[j]
        p[j] = old + 1e-3
        up = n.step(x, y)[0]
        p[j] = old - 1e-3
        down = n.step(x, y)[0]
        p[j] = old
        assert (up - down) / 2e-3 == pytest.approx(g[j], rel=0.02, abs=1e-6)


def test_padding_changes_nothing():
    n = language.Network(["a", "b"], 4, 2)
    x = np.full((9, 2), 256)
    x[:5] = np.array([1, 2, 3, 4, 5])[:, None]
    assert np.allclose(n.label(x)[:5], n.label(x[:5]), atol=1e-6)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op3_language(spark, d).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_odd_rows(docs, rows, empty):
    assert language.trained(docs) is None  # no labelled row
    n = language.Network(["en", "fr"])
    got = language.identified(docs, n).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    texts = dict(rows)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or ""))) for r in got if r.doc_id in (5001, 5002, 5003, 5006, 5009, 5011))
    kept = language.accepted(docs, n, 0.0)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in got)
    assert {r.lang_pred for r in language.identified(docs, None).collect()} == {"und"}
    assert language.identified(empty, n).collect() == []


def test_sample_holds_rare_languages_and_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language.Network, "train", lambda self, texts, y: seen.append((self.classes, texts, y)))
    long = "ganz lang " * 5000
    rows = [(i, f"text {i}", "en") for i in range(3000)] + [(5000 + i, f"mot {i}", "fr") for i in range(5)] + [(6000, long, "de"), (6001, long, "de"), (6004, long, "de"), (7000, None, "it"), (7001, "x", None)]
    language.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    classes, texts, y = seen[0]
    size = {c: int((y == i).sum()) for i, c in enumerate(classes)}
    may = [i for i in (*range(5000, 5005), 6000, 6001, 6004) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert size == {"en": language.PER_LANGUAGE, "fr": sum(i < 6000 for i in may), "de": sum(i >= 6000 for i in may)}
    assert long.encode() in texts
