"""Repeated strings against a plain count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

sd = pytest.importorskip("folioscope.llm.suffix_dedup")


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])))
        spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        kept = bytes(c for c, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df, **kw):
    return sorted(((r[0], r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256) for r in sd.repeated_spans(df, **kw).collect()), key=str)


def made(rng, shared, n=40):
    texts = []
    for _ in range(n):
        t = "".join(rng.choice("abcdé \n") for _ in range(rng.randrange(0, 500)))
        for s in rng.sample(shared, rng.randrange(0, 3)):
            cut = sorted(rng.sample(range(len(s) + 1), 2))
            at = rng.randrange(len(t) + 1)
            t = t[:at] + s[cut[0] : cut[1]] + t[at:]
        texts.append(t)
    return texts


@pytest.mark.parametrize("hot", [4096, 1])
def test_against_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rng = random.Random(5)
    shared = ["".join(rng.choice("xyzäw ") for _ in range(900)) for _ in range(6)] + ["q" * 700, "ab" * 500]
    texts = made(rng, shared) + [None, "", "same " * 90, "same " * 90, "q" * 399, "q" * 400, "q" * 401, "\0" * 450, "x" + "\0" * 450]
    texts += ["".join(rng.choice("lmnop") for _ in range(3000)) * 2]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, texts[4], 0)]
    want = plain([t for _, t, _ in rows], 400)
    df = spark.createDataFrame(rows, "doc_id long, text string, h int")
    assert got(df) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=str)


def test_short_lengths_and_passes(spark, monkeypatch):
    monkeypatch.setattr(sd, "PASS", 1000)
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 3, 50, 4000, 2500)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert got(df, length=24, gram=8) == sorted(((i, *w) for i, w in enumerate(plain(texts, 24))), key=str)
    assert got(df.limit(0)) == []


def test_deep_shallow_order():
    rng = random.Random(2)
    strings = [b"p" * rng.randrange(0, 130) + bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    group = np.array([rng.randrange(4) for _ in strings])
    padded, size = np.zeros((len(strings), 208), np.uint8), np.array([len(s) for s in strings])
    for i, s in enumerate(strings):
        padded[i, : len(s)] = np.frombuffer(s, np.uint8)
    order = sd.deep_shallow_order(group, padded, size)
    assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in zip(group, strings, strict=True))
    assert [strings[i] for i in sd.blind_trie_order(strings)] == sorted(strings)


def test_passages_of_words_that_other_rows_hold(spark):
    rng = random.Random(11)
    name = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    shared = [name(50), name(51), name(49), name(200)]
    own = " ".join(name(60))
    rows = [(0, " ".join(name(30) + shared[0] + name(9))), (1, " ".join(name(70)) + "\n" + ", ".join(shared[0]).upper()), (2, " ".join(shared[1] + name(5) + shared[3][:120])), (3, " ".join(name(5) + shared[1] + name(5) + shared[3]))]
    rows += [(4, " ".join(name(80) + shared[2])), (5, " ".join(shared[2] + name(80))), (6, own + " and " + own), (7, " ".join(shared[3][100:])), (8, "copy " * 49), (9, "copy " * 49), (10, "same " * 50), (11, "same " * 50), (12, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.n_passages for r in sd.repeated_spans(df).collect()}
    assert found == {0: 1, 1: 1, 2: 2, 3: 2, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0, 9: 0, 10: 1, 11: 1, 12: 0}
