"""Personal data: patterns against plain regular expressions, the tagger's gradient, accuracy and reconciliation."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termwell.llm import pii
from termwell.llm.pii import KINDS, Tagger, fit_tagger, op13_pii, pattern_spans, reconciled, scanned, with_pii, without_pii

SF = "/root/testdata/sf0.1"

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == 1:
            return all(int(part) <= 255 for part in found.split("."))
        if kind == 2:
            total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 10 <= len(digits) <= 15

    return sorted((m.start(), kind, m.end()) for kind, pattern in enumerate(PATTERNS) for m in re.finditer(pattern, text) if good(kind, m[0]))


def noise(rng, size, letters="ab@..--++00112233 99()_%é5\n"):
    return "".join(rng.choice(letters) for _ in range(size))


def test_patterns_equal_plain_expressions():
    rng = random.Random(7)
    cases = ["", "@", "a@b.c", "a@b.c_d@e.f", "a@b@c.d.", "..@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.1.1.1.9", "1..2.3.4.5", "+1 (017) 555-7713x",
             "++123 456 789 01-", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111 1111  1111 1111", "é@a.b é", "+12", "9" * 5000 + ".1.1.1",
             "a" * 50_000 + "@", "1" * 50_000, "+1" + "(" * 50_000, "@" * 20_000, "1." * 20_000]
    for text in cases[-6:]:
        pattern_spans(text)  # in time that grows with the length
    for text in cases[:-6] + [noise(rng, rng.randrange(80)) for _ in range(3000)]:
        assert pattern_spans(text) == plain_spans(text), text


def test_gradient():
    rng = np.random.default_rng(2)
    tagger = Tagger.fresh(rng, 5)
    x = rng.integers(0, pii.SYMBOLS, (3, 7))
    tags = np.array([[0, 1, 2, 2, 0, 3, 4], [2, 2, 0, 0, 7, 0, 5], [0] * 7])
    for w in tagger.weights()[5:]:
        w += rng.standard_normal(w.shape).astype(np.float32) * 0.3
    for field in ("wx", "wh", "b", "wo", "bo", "step", "first", "last"):
        setattr(tagger, field, getattr(tagger, field).astype(np.float64))
    _, grads = tagger.gradient(x, tags)
    for w, g in zip(tagger.weights(), grads, strict=True):
        for at in rng.choice(w.size, 12):
            place = np.unravel_index(at, w.shape)
            if w is tagger.step and pii._FORBIDDEN[place] < 0:
                continue
            kept = w[place]
            w[place] = kept + 1e-2
            more = tagger.gradient(x, tags)[0]
            w[place] = kept - 1e-2
            less = tagger.gradient(x, tags)[0]
            w[place] = kept
            assert abs((more - less) / 2e-2 - g[place]) < 3e-3


def test_viterbi_and_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    tagger = Tagger.fresh(rng, 4)
    for w in (tagger.step, tagger.first, tagger.last):
        w += rng.standard_normal(w.shape).astype(np.float32)
    e = (2 * rng.standard_normal((2, 4, pii.TAGS))).astype(np.float32)
    step = tagger.step + pii._FORBIDDEN
    for k in range(2):
        paths = list(itertools.product(range(pii.TAGS), repeat=4))
        scores = np.array([tagger.first[p[0]] + tagger.last[p[3]] + sum(e[k, t, p[t]] for t in range(4)) + sum(
            step[p[t], p[t + 1]] for t in range(3)) for p in paths])
        assert tuple(tagger.best(e)[k]) == paths[int(scores.argmax())]
        chance = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
        expected = np.zeros((4, pii.TAGS))
        for p, c in zip(paths, chance, strict=True):
            for t in range(4):
                expected[t, p[t]] += c
        assert np.allclose(tagger.marginals(e)[k], expected, atol=1e-4)


def test_reconciliation():
    assert reconciled([(40, 0, 48, 0.95, True), (40, 0, 60, 0.99, False), (48, 0, 60, 0.9, True)], []) == [(40, 0, 60, 0.99)]
    assert reconciled([(40, 0, 96, 0.95, True), (48, 0, 144, 0.97, True), (96, 0, 150, 0.96, True)], []) == [(40, 0, 150, 0.97)]
    assert reconciled([(1, 0, 9, 0.95, False)], [(8, 1, 12)]) == []
    rng = random.Random(3)
    for _ in range(200):
        found = [(a, rng.randrange(4), a + rng.randrange(1, 8), rng.choice([0.5, 0.91, 0.95, 0.99]), False) for a in [rng.randrange(20) for _ in range(8)]]
        kept = reconciled(found, [(3, 0, 5)])
        assert all(s[2] <= t[0] for s, t in itertools.pairwise(kept))
        able = [s[:4] for s in set(found) if s[3] >= 0.9 and (s[2] <= 3 or s[0] >= 5)]
        best = max(sum(s[3] for s in some) for n in range(len(able) + 1) for some in itertools.combinations(able, n)
                   if all(s[2] <= t[0] for s, t in itertools.pairwise(sorted(some))))
        assert abs(sum(s[3] for s in kept) - best) < 1e-9


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return fit_tagger(docs.filter("doc_id % 2 = 0"))


@pytest.fixture(scope="module")
def unseen(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 2 = 1").select("text").collect()]


def test_tagger_learns_the_patterns(tagger, unseen):
    """On texts it has not seen, without their patterns: what the tagger alone finds."""
    hits = wrong = truth = 0
    for text in unseen:
        base = set(pattern_spans(text))
        if not base:
            continue
        truth += len(base)
        found = set()
        for low in pii._window_starts(pii._points(text)).tolist():
            symbols = pii._symbols(pii._points(text)[low:low + pii.WIDTH])
            x = np.full((1, pii.WIDTH), pii.PAD)
            x[0, :len(symbols)] = symbols
            found |= {(low + a, k, low + b) for a, k, b, sure in pii.decoded(tagger, x)[0]
                      if sure >= pii.CONFIDENT and a > 8 and b < 88 and pii._sound(text, k, low + a, low + b)}
        hits += len(base & found)
        wrong += len([s for s in found - base if not any(s[0] < b and a < s[2] for a, _, b in base)])
    assert truth > 50 and hits / truth > 0.85 and wrong < 0.05 * truth


def test_tagger_finds_other_notations_and_leaves_clean_texts(tagger, unseen):
    rng = random.Random(9)
    found = total = 0
    clean = [t for t in unseen if t and not re.search("[0-9@]", t)]
    for text in unseen:
        for start, kind, end in pattern_spans(text):
            for pick in range(4):
                new = pii.rewritten(kind, text[start:end], pick)
                body = rng.choice(clean)[:200]
                made = f"{body} {new} {body}"
                total += 1
                found += any(a < len(body) + 1 + len(new) and b > len(body) + 1 and KINDS[k] == KINDS[kind] for a, k, b, *_ in scanned(tagger, [made])[0])
    assert total > 100 and found / total > 0.8
    extra = [s for text in unseen if not pattern_spans(text) for s in scanned(tagger, [text])[0]]
    quiet = sum(not pattern_spans(text) for text in unseen)
    assert len(extra) < 0.001 * quiet


def test_same_spans_whatever_the_batch(tagger, unseen):
    texts = [t for t in unseen if re.search("[0-9@]", t or "")][:60]
    together = scanned(tagger, texts)
    joined = scanned(tagger, ["x" * 48 * 500 + texts[0]])[0]
    assert [scanned(tagger, [t])[0] for t in texts[:20]] == together[:20] or all(
        [s[:4] for s in scanned(tagger, [t])[0]] == [s[:4] for s in spans] for t, spans in zip(texts[:20], together, strict=False))
    assert [(a - 24_000, k, b - 24_000) for a, k, b, base, _ in joined if base] == pattern_spans(texts[0])


def test_query_and_edge_cases(spark):
    out = op13_pii(spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        listed = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans) and [s for s in spans if s in listed] == listed
        keys = [(int(s.split(":")[1]), KINDS.index(s.split(":")[0])) for s in spans]
        assert keys == sorted(keys)


def test_tables_without_data(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "mail a.b@c.de or +1 (234) 555-0199 now é@", "x"), (3, "𝄞 1.2.3.4", "x")],
                                 "doc_id long, text string, pii string")
    assert fit_tagger(docs) is None and fit_tagger(docs.limit(0)) is None
    out = with_pii(docs, None)
    rows = out.withColumn("masked", without_pii(F.col("text"), F.col("pii"))).orderBy("doc_id", "text").collect()
    assert [r.masked for r in rows] == [None, "", "mail <email> or <phone> now é@", "𝄞 <ip>"]
    assert [len(r.pii) for r in rows] == [0, 0, 2, 1] and with_pii(docs.limit(0), None).count() == 0
    overlapping = spark.createDataFrame([("4111 1111 1111 1111@x.y z",)], "text string")
    row = with_pii(overlapping, None).withColumn("masked", without_pii(F.col("text"), F.col("pii"))).first()
    assert [(s.kind, s.start, s.end) for s in row.pii] == [("card", 0, 19), ("email", 15, 23)] and row.masked == "<card> z"
