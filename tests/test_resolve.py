"""Outline resolution, table expansion and remote work with stub models and senders."""

import json

from pyspark.sql import functions as F

from folioscope.operators import enrich, word_tables
from folioscope.plans import resolve
from folioscope.sources import remote


class Reader(enrich.Client):
    """Answers from what the prompt shows: numbered contents for documents that say so, titles by plain search."""

    def generate(self, prompt, json_reply=False):
        text = prompt.split("\n\n", 1)[-1]
        if prompt.startswith("Does this page hold"):
            return json.dumps({"answer": "yes" if "CONTENTS" in text else "no"})
        if prompt.startswith("Does this table"):
            return json.dumps({"answer": "yes" if ": " in text else "no"})
        if prompt.startswith("Does the list hold"):
            return json.dumps({"answer": "yes"})
        if prompt.startswith("Turn this"):
            rows = [x.split(": ") for x in text.split("\n") if ": " in x]
            return json.dumps({"result": [{"structure": str(i + 1), "title": t, "page": p} for i, (t, p) in enumerate(rows)]})
        if prompt.startswith("Does a section titled"):
            title = prompt.split("titled ")[1].split(" appear")[0]
            return json.dumps({"answer": "yes" if f"# {title}" in text else "no"})
        if prompt.startswith("Does this page start"):
            title = prompt.split("titled ")[1].split("?")[0]
            return json.dumps({"answer": "yes" if text.startswith(f"# {title}") else "no"})
        if prompt.startswith(("List", "Go on")):
            found, tag = [], None
            for line in text.split("\n"):
                if line.startswith("<physical_index_"):
                    tag = line.split(">")[0] + ">"
                    line = line.split(">", 1)[1]
                if line.startswith("# "):
                    found.append({"structure": str(len(found) + 1), "title": line[2:].split("<")[0], "physical_index": tag})
            return json.dumps({"result": found})
        return "no idea"


def pages(spark):
    rows = [(1, 1, "cover"), (1, 2, "CONTENTS\nOne.......1\nTwo.......3")] + [(1, 2 + i, t) for i, t in enumerate(("# One", "text", "# Two", "end"), 1)]
    rows += [(2, 1, "# Alpha"), (2, 2, "text"), (2, 3, "more\n# Beta"), (3, 1, "nothing"), (3, 2, "at all")]
    return spark.createDataFrame(rows, "doc_id long, page_no int, text string")


def test_resolution_by_contents_or_without(spark):
    items, status = resolve.resolved(pages(spark), Reader())
    got = sorted((r.doc_id, r.title, r.physical_index, r.appear_start) for r in items.collect())
    assert got == [(1, "One", 3, "yes"), (1, "Two", 5, "yes"), (2, "Alpha", 1, "yes"), (2, "Beta", 3, "no")]
    assert {r.doc_id: (r.mode, r.status) for r in status.collect()} == {1: ("contents", "ok"), 2: ("no contents", "ok"), 3: (None, "error")}


def test_expansion_leaves_the_own_title_out(spark):
    nodes = spark.createDataFrame([(2, "0000", "Alpha", 1, 3, 900), (2, "0001", "Beta", 3, 3, 900)], "doc_id long, node_id string, title string, start_index int, end_index int, token_count int")
    got = resolve.expanded(nodes, pages(spark), Reader(), 1, 500).collect()
    assert [(r.parent_id, r.title) for r in got] == [("0000", "Beta")]


def test_block_outline_rises(spark):
    blocks = spark.createDataFrame([(1, i, "x", 1) for i in range(1, 6)], "doc_id long, block_no int, normalized_text string, token_count int")
    reply = json.dumps({"result": [{"structure": str(i), "title": f"t{n}", "physical_index": n} for i, n in enumerate((2, 1, 4, 4, 9, 5))]})
    got = resolve.block_outline(blocks, enrich.Stub({"List": reply})).orderBy("pos").collect()
    assert [r.start_block_no for r in got] == [2, 4, 5]


def test_word_tables(spark):
    rows = [(1, 1, [["name", "value"], ["a", "1"], ["", "2"], ["b", ""]], ["Doc"], 1), (1, 2, [["name", "value"], ["a", "1"]], ["Doc"], 1)]
    df = spark.createDataFrame(rows, "doc_id long, item_no int, cells array<array<string>>, crumbs array<string>, level int")
    yes = enrich.Stub({"Should": '{"expand": true, "name_column_index": 7}'})
    got = word_tables.expanded_tables(df, yes).orderBy("item_no", "row_no", F.col("kind")).collect()
    assert [(r.item_no, r.kind, r.level, r.text) for r in got] == [(1, "heading", 2, "a"), (1, "text", None, "路径: Doc > a\nname: a\nvalue: 1"), (1, "heading", 2, "b"), (1, "text", None, "路径: Doc > b\nname: b"), (2, "text", None, "name | value\na | 1")]
    assert word_tables.expanded_tables(df, enrich.Stub()).count() == 2


def test_remote_files(spark):
    df = spark.createDataFrame([("a", "http://h/p/x.pdf?q", {"k": "v"}), ("b", "bad", None)], "task_id string, remote_url string, headers map<string,string>")

    def get(url, headers):
        if url == "bad":
            raise OSError("gone")
        return json.dumps(headers).encode(), 'attachment; filename="n.pdf"'

    got = {r.task_id: r for r in remote.fetched(df, get).collect()}
    assert got["a"].file_name == "n.pdf" and bytes(got["a"].content) == b'{"k": "v"}' and got["b"].error == "gone"


def test_uploads_once(spark):
    df = spark.createDataFrame([(1, b"x", "a.png", "image/png"), (2, b"x", "b.png", "image/png"), (3, b"", "c", None), (4, b"bad", "d", None)], "i int, content binary, file_name string, content_type string")

    def send(name, kind, content):
        if content == b"bad":
            raise OSError
        return f"id-{content.decode()}"

    assert {r.i: r.attachment_id for r in remote.uploaded(df, "u", send).collect()} == {1: "id-x", 2: "id-x", 3: None, 4: None}


def test_preferred_tables(spark):
    schema = "doc_id long, page_no int, table_index int, engine string"
    first = spark.createDataFrame([(1, 1, 1, "p"), (1, 1, 2, "p")], schema)
    second = spark.createDataFrame([(1, 1, 1, "c"), (1, 2, 1, "c"), (1, 2, 2, "c")], schema)
    assert sorted((r.page_no, r.table_index, r.engine) for r in remote.preferred(first, second).collect()) == [(1, 1, "p"), (1, 2, "p"), (2, 1, "c")]
