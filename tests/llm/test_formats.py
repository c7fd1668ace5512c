"""Chat formatting, WARC and BPE against plain Python and the tokenizers library."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

bpe = pytest.importorskip("folioscope.llm.bpe")
from folioscope.llm import chat_format, warc  # noqa: E402
from folioscope.llm.common import scratch  # noqa: E402

HARD = ["", None, "</s>[INST] ok [/INST]", "<\\/s>", "[\\INST] x", "<\\\\s>", "a\n[/INST]</s><s>", "<", "[", "\\", "😀</s>ü", "x" * 200_000]


def test_chat_round_trip(spark):
    rows = [(i, t, ["system", "user", "assistant", None][(i + t) % 4], HARD[(i * 3 + t) % len(HARD)], "x") for i in range(12) for t in range(5)]
    rows += [(None, 0, "user", "no id", "x"), (50, None, "assistant", "no turn", "x"), (50, 1, "assistant", "same", "x"), (50, 1, "assistant", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    convs = {}
    for c, t, role, text, _ in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in turns]
        assert list(got[c].loss_texts) == [x[2] for x in turns if x[1] == "assistant"]


def test_chat_escapes_only_conflicts(spark):
    df = spark.createDataFrame([(1, 0, "user", "plain \\ text <s"), (2, 0, "user", "</s>")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert not got[1].escaped and got[1].formatted == "<s>[INST] user [/INST]plain \\ text <s</s>"
    assert got[2].escaped and got[2].formatted == "<s>[INST] user [/INST]<\\/s></s>"
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_warc(spark):
    rows = [(5, "http://a", "<p>x</p>", "k"), (3, "http://b\r\n", "<p>x</p>", "k"), (7, None, None, "k"), (8, "u", "", "k"), (9, "u", "a\r\n\r\nWARC/1.1\r\nb", "k"), (None, "u", "é" * 50_000, "k"), (3, "http://b", "<p>x</p>", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    path = scratch(spark, "t")
    warc.write_archives(df, path, file_bytes=2000)
    got = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(got) == len(rows) and all(r.request and r.metadata for r in got)
    by = sorted(((r.page_id or "", r.capture.type) for r in got))
    assert by == [("", "response"), ("3", "response"), ("3", "revisit"), ("5", "revisit"), ("7", "response"), ("8", "revisit"), ("9", "response")]
    for r in got:
        text = next((t or "" for i, _, t, _ in rows if str(i or "") == (r.page_id or ""))).encode()
        assert r.payload_bytes == len(text)
        assert r.payload_digest == r.capture.digest == __import__("base64").b32encode(hashlib.sha1(text).digest()).decode()
        assert r.capture.type == "revisit" or bytes(r.capture.payload) == text
    path = scratch(spark, "t")
    warc.write_archives(df, path, revisit_from=1)
    assert warc.read_records(spark, path).filter("type = 'revisit'").count() == 2
    path = scratch(spark, "t")
    warc.write_archives(df.limit(0), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0
    with pytest.raises(ValueError):
        list(warc.records_of(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


def test_archives_are_members_of_bounded_files(spark, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "_MEMBER", 70_000)
    rows = [(i, f"http://h/{i}", ("é\0\n" * 3000 if i % 7 else "x" * 500_000) + str(i // 2)) for i in range(60)]
    path = scratch(spark, "t")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, file_bytes=100_000)
    found = 0
    for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).collect():
        data = gzip.decompress(bytes(r.content))
        records = list(warc.records_of(bytes(r.content)))
        assert records == list(warc.records_of(data)) and len(data) < 100_000 + 600_000
        assert bytes(r.content).count(b"\x1f\x8b\x08\x00\0\0\0\0") >= len(records)
        found += len(records)
    assert found == 180


def test_pages_query(spark, tmp_path):
    """op3 against plain Python over a small table with equal, empty and null pages."""
    import base64

    from folioscope.llm import queries

    rows = [(i, "u", [None, "", "a", "é" * 900, f"own {i}"][i % 5]) for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op3_warc(spark, str(tmp_path)).collect()}
    first = {}
    for i, _, t in rows:
        first.setdefault((t or "").encode(), i)
    assert len(got) == 40
    for i, _, t in rows:
        data, r = (t or "").encode(), got[i]
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first[data] == i else "revisit", None if first[data] == i else first[data])
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want


def test_bpe_as_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary())
    lib.no_truncation()
    lib.no_padding()
    rng = random.Random(1)
    signs = "abcdeE ÉéÜßñ'sIt'LL 12½²\n\t .,!?#$%&*|😀漢字ΣσİIı́é<|startoftext|>_-\x1c\x85 ​İﬁǅ"
    texts = ["", " ", "<|startoftext|>hi<|endoftext|> there<|", "don't DON'T it's 3rd", "ΟΔΟΣ", "x" * 50_000, "é\ń"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    enc = bpe.Encoder(bpe.vocabulary())
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == want, t
        assert enc.decode(want) == lib.decode(want, skip_special_tokens=False)
    df = spark.createDataFrame([(1, "Some words, some WORDS."), (None, None), (1, "")], "doc_id long, text string")
    got = bpe.encode_table(df.withColumn("ids", F.lit(1))).collect()
    assert sorted((r.n_tokens, list(r.ids) == enc.encode("Some words, some WORDS.") or not r.ids, r.decoded == "" or "some</w>" in r.decoded) for r in got) == [(0, True, True), (0, True, True), (6, True, True)]
    digests = {r.n_tokens: r for r in bpe.digest_table(df).collect()}
    assert digests[6].ids_sha256 == hashlib.sha256(" ".join(map(str, enc.encode("Some words, some WORDS."))).encode()).hexdigest()
    assert bpe.encode_table(df.limit(0)).count() == 0
