"""Quality, toxicity, decontamination and personal data against plain versions."""

import random
import re
import zlib

import numpy as np
import pytest

quality = pytest.importorskip("folioscope.llm.quality")
from folioscope.llm import decontaminate, pii, toxicity  # noqa: E402
from folioscope.llm.common import Memo  # noqa: E402

DIR = "/root/testdata/sf0.01"
ODD = [(9001, None), (9002, ""), (9003, "word " * 60_000), (9004, "\n\n"), (9004, "\n\n"), (None, "no id")]


def odd(spark):
    return spark.createDataFrame([(d, t, 0.5, 1) for d, t in ODD], "doc_id long, text string, score double, label int")


@pytest.mark.parametrize("module,label,mod,rest,least", [(quality, "quality", 4, 2, 0.97), (toxicity, "toxic", 5, 0, 0.93)])
def test_held_out_accuracy_and_odd_rows(spark, module, label, mod, rest, least):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    docs = docs.select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in got if r.doc_id is not None)
    y = {r.doc_id: r[label] for r in labels.collect()}
    held = [r.predicted == y[r.doc_id] for r in got if r.held_out and r.doc_id in y]
    assert np.mean(held) >= least
    # Held-out labels are no input: turning them over changes no score.
    from pyspark.sql import functions as F

    turned = labels.withColumn(label, F.when(module.remainder("doc_id", mod) == rest, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in module.classify(docs.filter("doc_id < 200"), turned).collect()}
    first = {r.doc_id: r.score for r in module.classify(docs.filter("doc_id < 200"), labels).collect()}
    assert again == first
    assert module.classify(odd(spark).limit(0), labels).count() == 0
    assert {r.predicted for r in module.classify(odd(spark), labels.limit(0)).collect()} == {1 if label == "quality" else 0}


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    dense = rng.random((700, 40)) * (rng.random((700, 40)) < 0.15)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    index = toxicity.Index(np.ones(40), dense, rng.integers(0, 2, 700).astype(float), np.arange(700))
    queries = rng.random((90, 40)) * (rng.random((90, 40)) < 0.2)
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    best, who = index.nearest(queries, 15)
    cos = queries @ index.dense.T
    want = -np.sort(-cos, axis=1)[:, :15]
    assert np.allclose(np.maximum(best, 0), np.maximum(want, 0), atol=1e-12)
    assert np.allclose(np.take_along_axis(cos, who, 1)[who >= 0], best[who >= 0], atol=1e-12)


def test_block_max_search_with_copies_and_small_pieces(monkeypatch):
    """Equal and nearly equal examples, empty rows, and terms that are all rare or all frequent, in pieces of any size."""
    rng = np.random.default_rng(5)
    for often, paired in ((1e9, 50), (0, 50), (32, 1 << 18)):
        monkeypatch.setattr(toxicity, "_OFTEN", often)
        monkeypatch.setattr(toxicity, "_PAIRED", paired)
        dense = rng.random((300, 60)) * (rng.random((300, 60)) < 0.2)
        dense[100:200] = dense[100] * (1 + 1e-9 * rng.random((100, 60)))
        dense[200:240] = dense[100]
        dense[250:255] = 0
        dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
        index = toxicity.Index(np.ones(60), dense, rng.integers(0, 2, 300).astype(float), np.arange(300))
        best, who = index.nearest(dense, 15)
        cos = np.round(dense @ index.dense.T, 12)
        want = np.argsort(-cos, axis=1, kind="stable")[:, :15]
        got = np.take_along_axis(cos, want, 1)
        assert np.allclose(np.maximum(best, 0), got, atol=1e-11)
        assert np.allclose(np.take_along_axis(cos, np.maximum(who, 0), 1)[who >= 0], best[who >= 0], atol=1e-11)
        assert (who[250:255] == -1).all()


def test_terms_agree_with_the_plain_count():
    texts = ["", "bad badly BAD bad", "a a a b", "Ünder über über", "x" * 50 + " badge", "good " * 4000]
    plain = [toxicity.terms_of(t) for t in texts]
    markers = sorted({t for p in plain for t in p if t.startswith(("^ba", "bad", "a", "good", "^goo"))})
    roots = {t: i for i, t in enumerate(sorted({t.split("#")[0] for t in markers}))}
    for known, of in (({t: i for i, t in enumerate(markers)}, roots), ({}, {})):
        row, at, n = toxicity._Terms(known, of, len(known)).entries(texts)
        names = {i: t for t, i in known.items()}
        for r, (text, want) in enumerate(zip(texts, plain, strict=True)):
            got = {int(a): int(c) for a, c in zip(at[row == r], n[row == r], strict=True)}
            assert {names[a]: c for a, c in got.items() if a in names} == {t: c for t, c in want.items() if t in known}
            slots = {}
            for w in words(text):
                slot = len(known) + zlib.crc32(w.encode()) % toxicity.WORDS
                slots[slot] = slots.get(slot, 0) + 1
            assert {a: c for a, c in got.items() if a not in names} == slots
        assert [len(x) for x in toxicity._Terms(known, of, len(known)).entries([])] == [0, 0, 0]


def test_every_supported_term_counts(spark):
    """400 words that mark label 1, each in few documents: a held-out text with any of them has evidence."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    taught = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 != 0]
    bad, good = taught[:400], taught[400:1200]
    rows = [(d, " ".join(name((37 * n + j) % 400) for j in range(6)), 1) for n, d in enumerate(bad)]
    rows += [(d, " ".join(name(5000 + (7 * n + j) % 900) for j in range(6)), 0) for n, d in enumerate(good)]
    asked = [(10_000 + i, f"{name(i)} {name(i)}", 1) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows + asked], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert all(got[d].evidence and got[d].predicted == 1 for d, _, _ in asked)
    assert not any(got[d].predicted for d in good)


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(docs, items):
    out = []
    wins = {}
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(str(name) if name is not None else "")
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, names in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= {*range(i, i + len(win))}
                    found |= names
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,shard", [(16_000_000, 1_000_000), (60, 50)])
def test_contamination(spark, monkeypatch, size, shard):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    rng = random.Random(8)
    voc = ["a", "b", "C", "dé", "9", "ü"]
    text = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(1, text(14)), (10, text(3)), (2, text(25)), (3, ""), (4, None), (None, text(12)), (2, text(11)), (5, "one! only")]
    docs = [(i, text(rng.randrange(0, 40)) + " " + (items[rng.randrange(len(items))][1] or "") + ". " + text(5)) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "One. ONLY"), (3, docs[3][1]), (None, docs[4][1]), (103, "a b " * 300)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r[0], r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(df, bench, pass_bytes=size).collect()), key=str)
    want = contaminated(docs, items)
    assert got == want
    kept = decontaminate.decontaminate(df, bench, pass_bytes=size)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((d, t) for d, t in docs if not contaminated([(d, t)], items)[0][2]), key=str)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(df, bench.limit(0)).collect()} == {0}


def plain_matches(docs, items, least=10):
    """Every maximal run of words that a document and a row of items share, found place by place; none within another."""
    out = []
    for d, t in docs:
        w, found = words(t), set()
        for name, item in items:
            v = words(item)
            m, own = min(least, len(v)), []
            for p in range(len(w)):
                for q in range(len(v)):
                    n = 0
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    if m and n >= m and (p == 0 or q == 0 or w[p - 1] != v[q - 1]):
                        own.append((p, n, q))
            own = [x for x in own if not any(y[0] <= x[0] and x[0] + x[1] <= y[0] + y[1] and y[:2] != x[:2] for y in own)]
            best = {}
            for p, n, q in own:  # of equal places in the document any place of the item will do
                best.setdefault((p, n), set()).add(q)
            found |= {(str(name) if name is not None else "", p, n, frozenset(q)) for (p, n), q in best.items()}
        out.append((d, found))
    return out


@pytest.mark.parametrize("size,piece", [(8_000_000, 200_000), (60, 7)])
def test_longest_matches(spark, monkeypatch, size, piece):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    monkeypatch.setattr(decontaminate, "_PAIRS", 5)
    rng = random.Random(4)
    voc = ["a", "b", "c", "d"]
    items = [(1, "a b c q q q b c x"), (2, " ".join(rng.choice(voc) for _ in range(60))), (3, "a b"), (4, "b " * 12), (2, " ".join(rng.choice(voc) for _ in range(30)))]
    docs = [(0, "z a b c x z"), (1, "z a b c q q q b c x"), (2, "b " * 9), (3, None)]
    docs += [(10 + i, " ".join(rng.choice(voc) for _ in range(5)) + " " + " ".join(items[1][1].split()[i : i + 11 + 3 * i]) + " z " + " ".join(items[4][1].split()[2 * i : 2 * i + 12])) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.matches for r in decontaminate.contamination(df, bench, window=4, pass_bytes=size).collect()}
    for d, want in plain_matches(docs, items, 4):
        held = {(m.item, m.start, m.words): m.item_start for m in got[d]}
        assert held.keys() == {x[:3] for x in want}, d
        assert all(held[x[:3]] in x[3] for x in want if sum(x[:3] == y[:3] for y in want) == 1)
        assert [m.start for m in got[d]] == sorted(m.start for m in got[d])
    # Windows of one item that do not follow one another in it are no longer match.
    assert {(m.item, m.start, m.words) for m in got[0]} == {("3", 1, 2)}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        double = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(sum(map(int, str(d))) for d in double) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_patterns_as_stated():
    rng = random.Random(9)
    texts = ["a@b.c", "a@b", "a@@b.c.d", "x.y@z-1.com.", "1.2.3.4.5.6.7.8", "300.1.1.1", "0255.1.1.1", "4111 1111-1111 1111", "+1 (706) 555-3138", "+12345", "é" * 10 + "a@b.cc", "9" * 5000, "a" * 5000 + "@", "+1" + " " * 3000]
    texts += ["".join(rng.choice("0123456789.@+- ()abA\né") for _ in range(rng.randrange(5, 80))) for _ in range(3000)]
    texts += ["".join(rng.choice(["4111111111111111", " ", "1.2.3.4", "@", "a.b", ".com", "+1 706 555 3138", "-"]) for _ in range(12)) for _ in range(500)]
    for t in texts:
        want = [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, t) if holds(k, m[0])]
        assert pii.base_spans(t) == want, t


def test_field_and_spans(spark):
    rows = pii.labelled_table(99)
    decoder = pii.Decoder(pii.trained())
    labels, start = decoder.labels([t for t, _ in rows])
    right = [labels[start[i] : start[i + 1]].tolist() == y for i, (_, y) in enumerate(rows)]
    assert np.mean(right) > 0.97

    def viterbi(tokens):  # one line, plainly
        f, e = decoder.field, []
        for t in range(len(tokens)):
            e.append(sum((f.weights[o, list(f.slots(tokens[u]))].sum(0) for o, u in ((0, t), (1, t - 1), (2, t + 1)) if 0 <= u < len(tokens)), np.zeros(len(pii.LABELS))))
        score, back = e[0], []
        for x in e[1:]:
            via = score[:, None] + f.steps
            back.append(via.argmax(0))
            score = via.max(0) + x
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    for i, (tokens, _) in enumerate(rows[::7]):
        assert viterbi(tokens) == labels[start[7 * i] : start[7 * i + 1]].tolist()
    # Weights drawn by chance leave few tokens certain; the labels are still those of the whole line.
    rng = np.random.default_rng(5)
    for scale in (0.2, 1.0):
        decoder = pii.Decoder(pii.Field(decoder.field.names, rng.normal(0, scale, decoder.field.weights.shape), rng.normal(0, scale, decoder.field.steps.shape)))
        decoder.field.weights[:, :, 0] += scale
        lines = [[t for row in rows[i : i + 3] for t in row[0]] for i in range(0, 300, 3)]
        labels, start = decoder.labels(lines)
        for i in range(0, 100, 9):
            assert viterbi(lines[i]) == labels[start[i] : start[i + 1]].tolist()
    text = "Hello,\n  call (415) 555-0132 now\ttoken = \"0123456789abcdef0123456789abcdef\"\nmail a@b.com"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (None, text, "x"), (1, text, "x")], "doc_id long, text string, spans string")
    got = pii.find_spans(df).collect()
    assert sorted(str(r[0]) for r in got) == ["1", "1", "2", "None"]
    for r in got:
        found = {(s.kind, text[s.start : s.end]) for s in r.spans}
        assert r.doc_id == 2 and not found or found == {("email", "a@b.com"), ("phone", "(415) 555-0132"), ("secret", "0123456789abcdef0123456789abcdef")}
        assert [s.kind for s in r.base] == ([] if r.doc_id == 2 else ["email"])
    assert {r.text for r in pii.mask(df).collect()} == {None, "Hello,\n  call <PHONE> now\ttoken = \"<SECRET>\"\nmail <EMAIL>"}
    assert pii.find_spans(df.limit(0)).count() == 0
    assert pii.masked("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a<IP>f"


def test_shapes_of_long_tokens_count_to_their_end():
    same = lambda a, b: all(np.array_equal(x, y) for x, y in zip(quality.features(a), quality.features(b), strict=True))
    start = "漢字" * 32
    assert not same(start + "漢字" * 500, start + "{};=" * 250)
    parts = [start, "x1" * 32, "=/;" * 21 + "A", "end"]
    assert same("".join(parts), " ".join(parts))
    assert not same("one two", "one six")
    assert quality.pieces("a bc\n" + "d" * 64) == ["a", "bc", "d" * 64]


def test_spans_are_the_same_in_long_lines():
    decoder = pii.Decoder(pii.trained())
    for lead in ("phone: 0123", "Call me at 415  555", "Tel. (415) "):
        text = f"{lead}   456789 after lunch."
        short = decoder.spans([text])[0]
        assert decoder.spans([text + " of the" * 2000])[0] == short
    assert pii._spans("0123  456789" + " x" * 4000, [1, 2] + [0] * 4000, 5) == [("phone", 5, 17)]
    assert decoder.spans(["My SSN: 123-45-6789, IBAN DE89 3704 0044 0532 0130 00 please"])[0] == [("id", 8, 19), ("iban", 26, 53)]
    assert pii._spans("0123 x 456789", [1, 0, 2], 0) == []
    assert pii.shape_features("a" * 128 + "1" * 400) != pii.shape_features("a" * 128)


def test_memo_forgets():
    m = Memo(lambda k: k + 1, limit=3)
    assert [m[i] for i in (1, 2, 3, 4, 1)] == [2, 3, 4, 5, 2] and len(m) == 2
