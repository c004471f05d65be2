"""Personal data against plain Python: spans, votes of labelers, reliabilities, classifier, overlaps."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tablewright.llm import personal_data as pd_

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_by_hand(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Python", "Pandas", "Arrow"))


def valid_card(rng, n=16):
    body = [rng.randrange(10) for _ in range(n - 1)]
    for last in range(10):
        if good("card", "".join(map(str, [*body, last]))):
            return "".join(map(str, [*body, last]))


@pytest.fixture(scope="module")
def corpus(prose):
    """Documents with personal data of every family, and numbers that are none."""
    rng = random.Random(9)
    make = [
        lambda: f"ana.{rng.randrange(99)}@mail.example.com", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)),
        lambda: valid_card(rng), lambda: "".join(rng.choice("0123456789") for _ in range(16)),
        lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
        lambda: "version 3.1.2", lambda: f"{rng.randrange(1990, 2024)}-0{rng.randrange(1, 9)}-11", lambda: f"bob{rng.randrange(9)} (at) example (dot) org",
        lambda: "call 743 555 38 24 today", lambda: "Mrs. Laura Smith", lambda: "1000000 kg", lambda: "long-word-with-hyphens-and-2-digits",
    ]
    rows = []
    for i in range(300):
        words = prose(300 + i, 30).split(" ")
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words)), rng.choice(make)())
        rows.append((i, " ".join(words)))
    return rows


def random_texts():
    rng = random.Random(10)
    parts = ["a@b.c", "@", ".", "+1 (2) 345-678", "4111 1111 1111 1111", "4111111111111111", " ", "-", "255.1.1.01", "256.1.1.1", "7", "é", "😀", "x.y-z", "%", "\n", "1.2.3", "+", "(", ")"]
    odd = [None, "", "a@b.c.d_e@f.g", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "00000000000000000000001.2.3.4", "+1" + "2" * 20, "1" * 40, "😀+12 345 678 901.", "x@y.z." * 50, "\\Ga@b.co"]
    return odd + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400)]


def test_base_spans(spark):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    report = pd_.span_report(df)
    no_python(report)
    for r in report.collect():
        want = base_by_hand(texts[r.doc_id])
        assert r.base_sha256 == digest(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in PLAIN]
        held = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert [s for s in held if s in set(want)] == want and held == sorted(held, key=lambda s: (pd_.KINDS.index(s[0]), *s[1:]))


def posteriors_by_hand(table, rounds=10, prior_votes=2.0):
    v = np.array([[r[k] for k in pd_.LABELERS] for r in table])
    n = np.array([r["n"] for r in table])
    family = np.array([r["family"] for r in table])
    weight = np.array([pd_.STARTING.get(k, 1) for k in pd_.LABELERS])
    p = ((v == 1) @ weight + 1) / ((v != 0) @ weight + 2)
    for _ in range(rounds):
        new = np.zeros(len(p))
        for f in set(family):
            at = family == f
            prior = ((n * p)[at].sum() + 1) / (n[at].sum() + 2)
            odds = np.full(at.sum(), math.log(prior / (1 - prior)))
            for j in range(v.shape[1]):
                chance = []
                for y, w in ((0, n * (1 - p)), (1, n * p)):
                    c = np.array([w[at & (v[:, j] == x)].sum() + prior_votes * (1 if x == 2 * y - 1 else 0.5) for x in (-1, 0, 1)])
                    c = c / c.sum()
                    if j == pd_.LABELERS.index("checksum") and y == 1:
                        c = np.array([0.001, *(c[1:] / c[1:].sum() * 0.999)])
                    chance.append(c)
                odds += np.log(chance[1] / chance[0])[v[at, j] + 1]
            new[at] = 1 / (1 + np.exp(-odds))
        p = new
    return p


def test_reliabilities_and_classifier(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(4)
    found = pd_.located(df)
    model = pd_.fit(found, l2=1e-2)
    table = pd_.counted(found).withColumns({"p": model.reliabilities.posterior(), "s": model.score(), **pd_.inputs()}).collect()
    p = posteriors_by_hand(table)
    assert np.allclose([r["p"] for r in table], p, atol=1e-9)
    # at the fitted weights the penalised likelihood has no slope
    x = np.array([[r[k] for k in model.weights] for r in table])
    n, s = np.array([r["n"] for r in table]), np.array([r["s"] for r in table])
    slope = (n * (s - p)) @ x / n.sum() + 1e-2 * np.array(list(model.weights.values()))
    assert np.abs(slope).max() < 1e-4 and abs((n * (s - p)).sum()) / n.sum() < 1e-4


def test_candidates_and_overlaps(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(4)
    found = pd_.located(df)
    model = pd_.fit(found)
    rows = {r.doc_id: r for r in found.collect()}
    scores = {tuple(r[k] for k in ("family", *pd_.LABELERS, *pd_.FEATURES)): r.s for r in pd_.counted(found).withColumn("s", model.score()).collect()}
    want = []
    for key, text in corpus:
        base = base_by_hand(text)
        got = rows[key]["_candidates"]
        assert [(c.start, c.end) for c in got] == [m.span() for m in regex.finditer(pd_.CANDIDATE, text)]
        want += [(key, *s, 1.0) for s in base]
        for c in got:
            s = scores[tuple(c[k] for k in ("family", *pd_.LABELERS, *pd_.FEATURES))]
            if s >= 0.5 and not any(a < c.end and c.start < b for _, a, b in base):
                want.append((key, c.kind, c.start, c.end, s))
    spans = [tuple(r) for r in pd_.find_spans(df).collect()]
    assert [s[:4] for s in sorted(spans)] == [s[:4] for s in sorted(want)]
    assert np.allclose([s[4] for s in sorted(spans)], [s[4] for s in sorted(want)])
    added = {(k, t[a:b]) for i, k, a, b, s in spans for t in [dict(corpus)[i]] if (k, a, b) not in base_by_hand(t)}
    assert any(k == "secret" for k, _ in added) and not any(k == "card" for k, _ in added) and any("(at)" in v for _, v in added)
    assert not any(v.startswith(("19", "20")) and v.endswith("-11") for _, v in added)
    report = {r.doc_id: r.spans for r in pd_.span_report(df).collect()}
    for key, _ in corpus:
        own = sorted((pd_.KINDS.index(k), a, b) for i, k, a, b, _ in spans if i == key)
        assert report[key] == ",".join(f"{pd_.KINDS[k]}:{a}:{b}" for k, a, b in own)


def test_votes(spark):
    cases = {
        "mail a.b@c.com": ("mail", 1, 0, 1, 1, 1, 0), "visa 4111111111111111": ("card", 0, 1, 1, 1, 1, 0), "x 4111111111111112 kg": ("card", 0, -1, 1, 1, 0, -1),
        "on 2021-05-11 then": ("number", -1, 0, -1, 0, 0, 0), "host 127.0.0.1 x": None, "host 127.10.20.1 x": ("number", 1, 0, 0, -1, 1, 0),
        "Dr. Maria Weiss": ("name", 0, 0, 0, 1, 0, 0), "version 1234567": ("number", 0, 0, -1, 0, -1, 0),
    }
    df = spark.createDataFrame([(t, t) for t in cases], "doc_id string, text string")
    for r in pd_.located(df).collect():
        got = [(c.family, *[c[k] for k in pd_.LABELERS]) for c in r["_candidates"]]
        assert got == ([cases[r.doc_id]] if cases[r.doc_id] else []), r.doc_id


def test_long_texts_take_linear_time(spark):
    long = ["1.1.1.1 " * 8_000, "a@" * 10_000, "a@b" + ".c" * 20_000, "+1" + " 2" * 20_000, "(" * 20_000 + "-" * 20_000]
    # the plain patterns are quadratic on runs of letters and digits, which hold no base span
    runs = ["a" * 500_000, "1" * 500_000, "é1" * 200_000]
    df = spark.createDataFrame(list(enumerate(long + runs)), "doc_id bigint, text string").repartition(4)
    for r in pd_.located(df).collect():
        want = base_by_hand(long[r.doc_id]) if r.doc_id < len(long) else []
        assert [(k, s.start, s.end) for k in pd_.BASE for s in r[f"_{k}"]] == want


def test_odd_rows_have_spans(odd, none, odd_rows):
    rows = pd_.span_report(odd).collect()
    assert len(rows) == len(odd_rows)
    want = sorted((str(r[0]), digest(base_by_hand(r[1]))) for r in odd_rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == want
    assert pd_.span_report(none).count() == 0 and pd_.find_spans(none).count() == 0


def test_masked_and_texts_that_are_not_utf8(spark):
    df = spark.sql("SELECT 'a@b.com, 4111111111111111 or 4111111111111112 at 1.2.3.4' AS text, cast(X'ff20614062632e636f' AS string) AS bad")
    r = df.select(pd_.masked(F.col("text")), pd_.masked(F.col("bad"))).first()
    assert r[0] == "[email], [card] or 4111111111111112 at [ip]" and r[1] == "� [email]"
    (s,) = pd_.span_report(df.select(F.lit(1).alias("doc_id"), F.col("bad").alias("text"))).collect()
    assert s.spans == "email:2:7"


def test_query_over_documents(spark, sf_dir):
    from tablewright.llm.queries import R

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = R.queries["op11_personal_data"](spark, sf_dir)
    no_python(got)
    for r in got.collect():
        assert r.base_sha256 == digest(base_by_hand(texts[r.doc_id]))
