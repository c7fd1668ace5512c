"""Settings, logs, tokenizers, clients and the task service."""

import json
import logging
import os
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from folioscope import logs, settings
from folioscope.functions import tokenizers
from folioscope.operators import enrich
from folioscope.streaming import service, tasks


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# note\nexport FOLIOSCOPE_MODEL='m1'\nFOLIOSCOPE_CONCURRENT_TASKS=9\nOTHER=x\n")
    held, model = settings.load({"FOLIOSCOPE_CONCURRENT_TASKS": "3", "FOLIOSCOPE_LOG_LEVEL": "  ", "FOLIOSCOPE_OPTIONS": '{"a": 1}'}, str(env))
    assert (held.concurrent_tasks, held.log_level, held.calls_per_minute) == (3, "INFO", 30)
    assert (model.model, model.options, model.provider) == ("m1", {"a": 1}, "http") and model.required() is model
    for raw in ("[1]", "{"):
        with pytest.raises(ValueError):
            settings.load({"FOLIOSCOPE_OPTIONS": raw}, "none")
    with pytest.raises(ValueError):
        settings.load({}, "none")[1].required()


def test_log_events():
    sent = []
    handler = logs.EventHandler("http://h/", "k", send=lambda url, body, headers: sent.append((url, json.loads(body), headers)))
    log = logging.Logger("t")
    log.addHandler(handler)
    log.warning("went %s", "on", extra={"task": 7})
    log.info({"message": "told", "n": 1})
    try:
        raise OSError("gone")
    except OSError:
        log.exception("failed")
    url, first, headers = sent[0]
    assert url == "http://h/api/events/raw?clef" and headers["X-Seq-ApiKey"] == "k"
    assert (first["@mt"], first["@l"], first["task"], first["logger"]) == ("went on", "Warning", 7, "t") and first["@t"].endswith("Z")
    assert (sent[1][1]["@mt"], sent[1][1]["n"]) == ("told", 1) and "OSError: gone" in sent[2][1]["@x"]
    handler.send = lambda *_: 1 / 0
    handler.handleError = lambda record: sent.append("error")
    log.error("x")
    assert sent[-1] == "error"
    with pytest.raises(ValueError):
        logs.EventHandler("")
    assert logs.logger("a", task=1).extra == {"task": 1}


def test_clients():
    c = enrich.client_of("messages", url="u", key="k", model="m")
    assert c.body("hi", True)["messages"][0]["content"].startswith("hi\n\n") and c.body("hi", False)["messages"][0]["content"] == "hi"
    assert c.text({"content": [{"type": "text", "text": "a"}, {"type": "x"}, {"type": "text", "text": "b"}], "stop_reason": "max_tokens"}) == ("ab", True)
    with pytest.raises(ValueError):
        enrich.MessagesClient("u", "", "m")
    with pytest.raises(ValueError):
        enrich.active()
    with enrich.using(enrich.Stub()) as stub:
        assert enrich.active() is stub and enrich.active(c) is c


def test_quota_and_kept_replies(spark, tmp_path):
    class Counted(enrich.Client):
        def generate(self, prompt, json_reply=False):
            (tmp_path / f"{prompt}-{os.urandom(4).hex()}").write_text("")
            return prompt.upper()

    rows = enrich.called(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "p string"), F.col("p"), Counted(), per_minute=8)
    for _ in range(2):
        assert sorted((r.p or "", r.reply) for r in rows.collect()) == [("", None), ("a", "A"), ("a", "A"), ("b", "B")]
    assert len(list(tmp_path.iterdir())) == 2


def test_image_texts(spark):
    df = spark.createDataFrame([(1, "cat.png")], "i int, title string")
    got = enrich.image_texts(df, enrich.Stub({"alternative text": " a \n cat ", "Describe": "x" * 300})).first()
    assert (got.alt, len(got.description)) == ("a cat", 200)


VOCAB = "/opt/tokenizers"


@pytest.mark.skipif(not os.path.isdir(VOCAB), reason="no vocabulary files here")
def test_token_counts(spark):
    import sentencepiece
    import tokenizers as lib

    texts = ["Hello there, World 12!", "", None, "ünïcode \n\n x", "a" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    bpe = lib.Tokenizer.from_file(f"{VOCAB}/byte_bpe_50k.json")
    piece = sentencepiece.SentencePieceProcessor(model_file=f"{VOCAB}/piece_bpe_32k.model")
    want = {"byte_bpe_50k.json": lambda t: len(bpe.encode(t, add_special_tokens=False).ids), "byte_bpe_50k.tiktoken": lambda t: len(bpe.encode(t, add_special_tokens=False).ids), "piece_bpe_32k.model": lambda t: len(piece.encode(t))}
    for name, count in want.items():
        got = df.select("i", tokenizers.counted(F.col("text"), f"{VOCAB}/{name}").alias("n")).orderBy("i").collect()
        assert [r.n for r in got] == [count(t) if t else 0 for t in texts], name
    assert [r.n for r in df.select("i", tokenizers.counted(F.col("text")).alias("n")).orderBy("i").collect()] == [5, 0, 0, 3, 75]
    with pytest.raises(ValueError):
        tokenizers.encoder("x.bin")


def body(**fields):
    return json.dumps({"task_id": 1, "callback_url": "http://c", "remote_file_url": "http://f", **fields}).encode()


def test_bodies():
    got = service.parsed("application/json", body(index_options={"a": 1}))
    assert got["index_options"] == {"a": 1} and got["callback_headers"] == {} and got["file"] is None
    sign = "xyz"
    part = lambda name, data, more="": f'--{sign}\r\nContent-Disposition: form-data; name="{name}"{more}\r\n\r\n{data}\r\n'
    form = part("task_id", "t") + part("callback_url", "c") + part("index_options", '{"b": 2}') + part("file", "# Title", '; filename="a.md"') + f"--{sign}--\r\n"
    got = service.parsed(f"multipart/form-data; boundary={sign}", form.encode())
    assert got["file"] == ("a.md", b"# Title") and got["index_options"] == {"b": 2} and got["task_id"] == "t"
    for bad in (b"{", b"[]", body(task_id=""), body(remote_file_url=None), body(index_options=[1]), body(callback_headers="[")):
        with pytest.raises(service.BadRequest):
            service.parsed("application/json", bad)
    with pytest.raises(service.BadRequest):
        service.parsed(f"multipart/form-data; boundary={sign}", (part("remote_file_url", "u") + form).encode())


def test_service_and_stream(spark, tmp_path):
    web = service.server(str(tmp_path / "requests"))
    threading.Thread(target=web.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{web.server_port}"
    try:
        assert json.load(urllib.request.urlopen(f"{at}/healthz")) == {"status": "ok"}
        ask = lambda data: urllib.request.urlopen(urllib.request.Request(f"{at}/tasks", data, {"Content-Type": "application/json"}))
        with ask(body(task_id="t1")) as got:
            assert got.status == 202 and json.load(got) == {"task_id": "t1", "status": "accepted"}
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(body(task_id=None))
        assert e.value.code == 400
    finally:
        web.shutdown()
        web.server_close()
    query = tasks.run_stream(spark, str(tmp_path / "requests"), str(tmp_path / "events"), str(tmp_path / "check"))
    query.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "events")).orderBy("seq").collect()
    assert [r.stage for r in rows] == ["accepted", "fetching", "indexing", "finalizing", "completed"]
