import os
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from quarryline.llm import common, language, packing, pii

from .test_copies import LOWER, near_classes
from .test_rules import all_spans


def redact(x, model):
    spans = sorted((a, b, k) for k, a, b in all_spans(x or "", model)[1])
    out, end = "", 0
    for a, b, k in spans:
        if a >= end:
            out += x[end:a] + f"[{pii.KINDS[k].upper()}]"
        end = max(end, b)
    return out + x[end:] if spans else x


def test_stages_against_brute_force(spark, docs, small, ordered):
    """Each stage on all that its predecessor kept: the smallest documents, odd rows, and columns with clashing names."""
    labelled = spark.read.parquet(f"{small}/documents.parquet")
    network = language.trained(labelled)
    table = docs.drop("lang", "source", "n_chars").join(labelled.select("doc_id", "lang", "source", "n_chars").dropDuplicates(["doc_id"]), "doc_id", "left")
    table = common.written(table.select("doc_id", "text", "lang", "source", "n_chars", "kept", "row_id", "block", "group_size"), "odd")
    before = [(r.doc_id, r.text) for r in table.collect()]
    scored = {}
    for r in language.identified(table.dropDuplicates(["text"]).selectExpr("crc32(encode(coalesce(text, ''), 'utf-8')) AS doc_id", "text"), network).collect():
        scored[r.doc_id] = r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE
    (_, one), (_, two), (_, three), (_, four), (_, five) = corpus_pipeline.STAGES
    step = lambda stage, df: common.written_alone(lambda: stage(spark, df, small), stage.__name__)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    out = step(one, table)
    assert out.columns == table.columns
    own = language.trained(table)
    if own is not None and [p.tolist() for p in own.parameters()] == [p.tolist() for p in network.parameters()]:
        assert ordered(rows(out)) == ordered(x for x in before if scored[zlib.crc32((x[1] or "").encode())])
    assert set(rows(out)) <= set(before) and not any(not any(map(str.isalpha, x or "")) for _, x in rows(out))

    before = rows(table)  # the next stages are tried on the odd rows too
    out = step(two, table)
    groups = {}
    for i, x in before:
        groups.setdefault((x or "").translate(LOWER), []).append(-1 if i is None else i)
    assert out.columns == table.columns
    assert ordered((-1 if i is None else i, (x or "").translate(LOWER)) for i, x in rows(out)) == ordered((max(ids), low) for low, ids in groups.items())

    before = rows(out)
    out = step(three, out)
    classes = near_classes(before)
    keep = lambda places: min((before[i][0] for i in places), key=lambda i: (i is None, i or 0))
    assert out.columns == table.columns and ordered((i,) for i, _ in rows(out)) == ordered((keep(c),) for c in classes)
    assert set(rows(out)) <= set(before)

    before, model = rows(out), pii.trained(spark)
    out = step(four, out)
    assert out.columns == table.columns and ordered(rows(out)) == ordered((i, redact(x, model)) for i, x in before)
    assert all(r.n_chars == len(r.text or "") or r.text is None for r in out.collect())

    before, t = rows(out), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, x in before:
        ids, at = [*t.encode(x or "", add_special_tokens=False).ids, 1], 0
        for size in packing.binary_lengths(len(ids), 2048):
            want.append((i, at, np.array(ids[at : at + size], "<u4").tobytes()))
            at += size
    assert ordered((r.doc_id, r.start, bytes(r.ids)) for r in step(five, out).collect()) == ordered(want)


def test_stages_take_an_empty_table(spark, empty, small):
    table = empty
    for name, stage in corpus_pipeline.STAGES:
        table = common.written_alone(lambda: stage(spark, table, small), name)
        assert table.collect() == [], name


def test_run_leaves_one_table(spark, small):
    folder = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and len(set(os.listdir(folder)) - before) == 1
