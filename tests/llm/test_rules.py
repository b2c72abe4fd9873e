import hashlib
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa

from quarryline.llm import licenses, pii, quality, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_quality(docs, rows, ordered):
    def brute(x):
        x = x or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, dup = set(), 0
        for line in x.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)

    got = quality.repetition(docs).collect()
    assert ordered(tuple(r)[:7] for r in got) == ordered((i, *brute(x)) for i, x in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_compares_words_by_their_bytes(spark, monkeypatch):
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, two = ("".join(x[b] for b in bits) for x in ("ab", "ba"))
    own = ["p", "q", "r", "s"]
    texts = [" ".join([*own, one, "x", *own, two]), " ".join([*own, one, "x", *own, one])]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(texts)], ["doc_id", "text"])
    for _ in range(2):
        got = next(quality._measure(iter([batch]))).to_pylist()
        assert [r["n_repeat_words"] for r in got] == [0, 10] and [r["base_failed"] for r in got] == [False, True]
        for module in (quality, words):  # the second time all words have one hash
            monkeypatch.setattr(module, "word_hashes", lambda buf, starts, ends: np.ones(len(starts), np.uint64))


def test_licenses(docs, rows, spark, ordered):
    more = [(7000, "CC-BY-NC cc by nc"), (7001, "xcc by nc"), (7002, "under the MIT License. Apache License, Version 2.0"), (7003, "under THE\nMIT--LICENSE! " * 50), (7004, "Licensed under the Apache License, Version 2.0, and GPL v3 license"), (7005, "cc-by-nc-sa 4.0")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))

    def brute(x):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    at.append(i)
                    labels.add(label)
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))

    got = licenses.scanned(df).collect()
    assert ordered(tuple(r)[:6] for r in got) == ordered((i, *brute(x)) for i, x in [*rows, *more])
    labels = {r.doc_id: r.labels for r in got}
    assert labels[7005] == "cc-by-nc,cc-by-nc-sa-4.0" and labels[7004] == "apache-2,gpl-3" and labels[7001] == ""
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got if r.base_labels)


def examples(regex, most=400):
    """Texts that a rule matches: each choice of its alternatives and optional parts, one digit for a run of digits."""

    def of(items):
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                part = [chr(arg)]
            elif name == "IN":
                part = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg]
            elif name == "MAX_REPEAT":
                part = [*([""] if arg[0] == 0 else []), *of(arg[2])]
            elif name == "BRANCH":
                part = [x for branch in arg[1] for x in of(branch)]
            else:
                part = of(arg[-1])
            out = [a + b for a in out for b in part]
        return out

    every = of(re._parser.parse(regex))
    return every if len(every) <= most else random.Random(regex).sample(every, most)


def scan(text, rules=licenses.RULES):
    """Detections that aren't suppressed: every rule on every text, every pair of detections."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    line = f" {' '.join(w)} "
    every = []
    for rank, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", line):
            start = line[: m.start()].count(" ") - 1
            every.append((start, start + m.group().count(" ") + 1, rank, r))

    def gives_way(d, o):
        inside = o[0] <= d[0] and o[1] >= d[1]
        longer, same = o[1] - o[0] > d[1] - d[0], o[:2] == d[:2]
        return inside and (o[3].priority > d[3].priority or (o[3].priority == d[3].priority and (longer or (same and o[2] < d[2]))))

    kept = [d for d in every if d[3].base or not any(gives_way(d, o) for o in every)]
    return sorted((d[0], d[1], d[2]) for d in kept), ",".join(sorted({d[3].label for d in kept})), max((d[3].confidence for d in kept), default=0.0)


def test_license_rules_and_gates(spark, rows, ordered):
    """Each rule is found through both gates; labels, intervals and scores are those of a scan without gates."""
    rules = licenses.RULES
    assert len({r.regex for r in rules}) == len(rules) >= 200
    made = [(r, x) for r in rules for x in examples(r.regex)]
    assert all(re.search(r.regex, x) and all(f" {k} " in f" {x} " for k in r.keyword.split("&")) for r, x in made)
    gate = licenses.gate_words()
    assert [x for _, x in made if not set(gate) & set(x.split())] == []
    one = [examples(r.regex, 3) for r in rules]
    texts = ["Released under the MPL 2.0.", "Distributed\n\nunder the BSL 1.0", "available under EPL v2", "PROVIDED -- UNDER the EUPL 1.2", "published under an OSL 3.0", "found under the stairs"]
    texts += [x.upper().replace(" ", " - ") for some in one for x in some]
    shuffled = random.Random(1)
    for _ in range(60):
        texts.append(" ".join(x for some in shuffled.sample(one, 12) for x in shuffled.sample(some, 1)))
    texts += [x for _, x in rows] + ["Licensed under the GPL v2 or later license; all rights reserved. " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in licenses.scanned(df).collect()}
    assert [got[i].labels for i in range(6)] == ["mpl-2", "bsl-1", "epl-2", "eupl-1.2", "osl-3", ""]
    for i, x in enumerate(texts):
        if i == len(texts) - 1:
            continue
        spans, labels, score = scan(x)
        assert sorted((d.start, d.end, d.rank) for d in got[i].detections) == spans and got[i].labels == labels and got[i].score == score, x
    spans, labels, _ = scan(texts[-1][: len(texts[-1]) // 3000 * 4])
    assert got[len(texts) - 1].labels == labels and len(got[len(texts) - 1].detections) * 4 == len(spans) * 3000
    assert ordered(licenses.scanned(df.filter("doc_id < 400"), gated=False).collect()) == ordered(r for r in got.values() if r.doc_id < 400)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(v):
    return re.sub("[^0-9]", "", v)


def base_of(x):
    """Base spans by kind, by the contract's own patterns."""
    kinds = {
        "email": ("@", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (".", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": ("", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    }
    # a text without the sign that each match must hold has no match
    return {k: [m.span() for m in re.finditer(p, x) if ok(m.group())] if sign in x else [] for k, (sign, p, ok) in kinds.items()}


def features_of(x, k, own, m):
    v, left = m.group(), x[max(0, m.start() - pii.CONTEXT) : m.start()].lower()
    n = lambda p: len(re.findall(p, v))
    has = lambda p: float(bool(re.search(p, left)))
    return [
        k, len(v), n("[0-9]"), n("[A-Z]"), n("[a-z]"), n("[^A-Za-z0-9]"), len(set(v)), float(bool(re.fullmatch("[0-9a-fA-F]+", v))), float(12 <= len(digits(v)) <= 19 and luhn(digits(v))),
        has(own), has("|".join(g[2] for g in pii.GENERATORS)), has(pii.OTHER_WORDS), has(r"[=:]\s*[\"']?\Z"), has(r"[\"']\Z"), has(r"[/\\.]\Z"),
        float(bool(re.fullmatch("[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", v))), n("(?<![A-Za-z0-9])[A-Za-z]{2,}(?![A-Za-z0-9])"), n("[A-Za-z][0-9]|[0-9][A-Za-z]"), float(not re.match("(?:000|666|9[0-9][0-9])-", v)),
    ]


def all_spans(x, model):
    """All spans: every candidate against every base span and every other candidate."""
    base = [(i, a, b) for i, (k, found) in enumerate(base_of(x).items()) for a, b in found]
    scored = []
    for i, (_, pattern, own) in enumerate(pii.GENERATORS):
        k = len(pii.BASE_KINDS) + i
        for m in re.finditer(pattern, x) if re.search("[0-9@]", x) else []:
            p = float(model.probability(np.array([features_of(x, k, own, m)], float))[0])
            if p >= model.thresholds.get(k, 0.99):
                scored.append((p, k, m.start(), m.end()))
    over = lambda a, b: a[0] < b[1] and b[0] < a[1]
    better = lambda a, b: (-b[0], b[1], b[2]) < (-a[0], a[1], a[2])
    extra = [a[1:] for a in scored if not any(over(a[2:], b[1:]) for b in base) and not any(over(a[2:], b[2:]) and better(a, b) for b in scored)]
    return base, sorted(base + extra)


def test_pii(docs, rows, spark, ordered):
    sys.set_int_max_str_digits(0)
    more = [(7000, "a@b.c@d.e a@b.co_x@y.z ..@x.y. é a.b%c@d-e.f.g..h"), (7001, "1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1"), (7002, "4785 3805-9239 1391  1 4785380592391391"), (7003, "+1 (743) 555-3824 +12 +123456789012345678"), (7004, "\x01a@b.c \x012.2.2.2"), (7005, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x')]
    more += [(7100 + i, x) for i, (x, _) in enumerate(pii.training_texts(6, 31))]
    more += [(7500, " ".join(x for x, _ in pii.training_texts(3, 33))), (7501, "".join(f"u{i}@ex.org +1 (743) 555-{i:04d} " for i in range(4000)))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    model = pii.trained(spark)

    def brute(x):
        spans = base_of(x or "")
        text = ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)
        every = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in all_spans(x or "", model)[1]) if len(x or "") < 100_000 else None
        return *(len(v) for v in spans.values()), hashlib.sha256(text.encode()).hexdigest(), every

    got = pii.reported(df).collect()
    want = [(i, *brute(x)) for i, x in [*rows, *more]]
    assert ordered((*tuple(r)[:6], r.spans if r.doc_id != 7501 else None) for r in got) == ordered(want)
    spans = {r.doc_id: r.spans for r in got}
    assert "secret:9:49" in spans[7005] and spans[7501].count("email") == 4000 and spans[7501].count(",") == 7999
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect() if r.doc_id in (7003, 7005, 5002, 5001)}
    assert clean == {7003: "[PHONE] +12 +123456789012345678", 7005: 'token = "[SECRET]" x', 5002: "", 5001: None}


def test_pii_redacts_any_column_beside_any_names(spark):
    df = spark.createDataFrame([(1, "x a@b.co y", 2), (2, None, 3)], "pii_spans long, `the text` string, __t long")
    got = pii.redacted(df, "the text")
    assert got.columns == df.columns and [r["the text"] for r in got.collect()] == ["x [EMAIL] y", None]


def test_pii_leaves_lookalikes_alone(spark):
    left = ["very-long-hyphenated-release-name-2024-edition", "commit 3f785aa1b2c4d5e6f708192a3b4c5d6e7f80001b", "section 123-45-6789 of the part list", "id 123e4567-e89b-12d3-a456-426614174000", "ISBN 978-3-1614-8410-0", "https://example.org/a/deep_path_2024_version_3/x", "released 2024-11-12"]
    taken = ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "SSN: 123-45-6789", "born 1980-10-12", "call (743) 555-3824", "IBAN DE44 5001 0517 5407 3249 31"]
    df = spark.createDataFrame(list(enumerate(left + taken)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.reported(df).collect()}
    assert [got[i] for i in range(len(left))] == [""] * len(left) and all(got[len(left) + i] for i in range(len(taken)))


def test_pii_precision_and_recall(spark):
    """On texts of another seed, by kind."""
    model, made = pii.trained(spark), pii.training_texts(60, 99)
    x, y, kind, _ = pii.training_rows(spark, made)
    p = model.probability(x)
    for k in np.unique(kind):
        own = kind == k
        taken = p[own] >= model.thresholds[int(k)]
        precision, recall = y[own][taken].mean(), taken[y[own]].mean()
        print(pii.KINDS[k], int(own.sum()), round(precision, 3), round(recall, 3), round(model.thresholds[int(k)], 3))
        assert precision >= 0.9 and recall >= 0.7, pii.KINDS[k]


def test_empty(empty):
    for out in (quality.repetition(empty), licenses.scanned(empty), pii.reported(empty)):
        assert out.collect() == []
