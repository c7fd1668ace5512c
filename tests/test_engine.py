"""The engine's operators against plain Python."""

import io
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.functions import tables as T
from folioscope.functions import text as X
from folioscope.operators import blocks, enrich, export, link, outline, packing, search, tree
from folioscope.plans import index
from folioscope.sources import files
from folioscope.streaming import tasks


def level_rows(seed, docs=30, levels=(1, 2, 3, 5)):
    rng = random.Random(seed)
    return [(d, p, rng.choice(levels), f"t{p}", "x" * rng.randrange(0, 60)) for d in range(docs) for p in range(1, rng.randrange(2, 25))]


def plain_tree(rows):
    """(doc, pos) -> ancestors, by a stack."""
    out, stack, doc = {}, [], None
    for d, p, level, *_ in rows:
        if d != doc:
            stack, doc = [], d
        while stack and stack[-1][1] >= level:
            stack.pop()
        out[d, p] = [x for x, _ in stack]
        stack.append((p, level))
    return out


def made(spark, rows):
    return tree.level_tree(spark.createDataFrame(rows, "doc_id long, pos long, level int, title string, text string"), [1, 2, 3, 5])


def test_level_tree(spark):
    rows = level_rows(1)
    want = plain_tree(rows)
    got = made(spark, rows).collect()
    assert {(r.doc_id, r.pos): list(r.path) for r in got} == want
    for r in got:
        under = [p for (d, p), path in want.items() if d == r.doc_id and r.pos in path]
        assert r.subtree_end == max([r.pos, *under]) and r.depth == len(r.path) + 1


def test_code_tree_orders_ids_by_the_tree(spark):
    items = [(1, 0, "1"), (1, 1, "1.1"), (1, 2, "2"), (1, 3, "1.2"), (1, 4, "3.1"), (1, 5, "1.2.1"), (1, 6, None)]
    got = {r.structure: r for r in tree.code_tree(spark.createDataFrame(items, "doc_id long, pos long, structure string")).collect()}
    assert [got[c].node_id for c in ("1", "1.1", "1.2", "1.2.1", "2", "3.1")] == ["0000", "0001", "0002", "0003", "0004", "0005"]
    assert got["3.1"].parent_pos is None and list(got["1.2.1"].path) == [0, 3]


def descend(rows, place):
    """Node ids of a plain descent; rows: pos, path, start, end."""
    kids = {}
    for p, path, a, b in rows:
        kids.setdefault(path[-1] if path else None, []).append((p, a, b))

    def find(up):
        best = None
        for p, a, b in kids.get(up, []):
            if a <= place <= b:
                below = find(p)
                if below is not None:
                    return below
                best = p
        return best

    return find(None)


def test_links(spark):
    rng = random.Random(2)
    rows = [(*r[:3], r[3], r[4]) for r in level_rows(3, 12)]
    spans = {(r[0], r[1]): (a := rng.randrange(1, 8), a + rng.randrange(-1, 6)) for r in rows}
    t = made(spark, rows)
    s = spark.createDataFrame([(d, p, a, b) for (d, p), (a, b) in spans.items()], "doc_id long, pos long, start_index int, end_index int")
    t = t.join(s, ["doc_id", "pos"]).cache()
    flat = {}
    for r in t.orderBy("doc_id", "pos").collect():
        flat.setdefault(r.doc_id, []).append((r.pos, list(r.path), r.start_index, r.end_index))
    ids = {(r.doc_id, r.node_id): r.pos for r in t.collect()}
    first = {(r.doc_id, r.place): ids[r.doc_id, r.node_id] for r in link.first_match(t).collect()}
    deep = {(r.doc_id, r.place): ids[r.doc_id, r.node_id] for r in link.deepest(t).collect()}
    for d, held in flat.items():
        for place in range(0, 16):
            assert first.get((d, place)) == descend(held, place)
            over = [(-len(path), p) for p, path, a, b in held if a <= place <= b]
            assert deep.get((d, place)) == (min(over)[1] if over else None)


def test_thinning(spark):
    rows = level_rows(4, 15)
    want, texts = plain_tree(rows), {(d, p): t for d, p, _, _, t in rows}

    def count(d, p):
        whole = "\n".join(texts[d, q] for (e, q), path in sorted(want.items()) if e == d and (q == p or p in path))
        return max(1, len(whole) // 4) if whole else 0

    got = {(r.doc_id, r.pos): r.text for r in tree.thinned(made(spark, rows), 20).collect()}
    assert set(got) == {k for k, path in want.items() if all(count(k[0], a) >= 20 for a in path)}
    for (d, p), text in got.items():
        if count(d, p) < 20:
            assert text == "\n\n".join(texts[e, q] for (e, q), path in sorted(want.items()) if e == d and (q == p or p in path) and texts[e, q])
        else:
            assert text == texts[d, p]


def test_nested_json(spark):
    rows = level_rows(5, 6)
    t = made(spark, rows)
    got = {r.doc_id: json.loads(r.structure) for r in tree.nested_json(t, ["title", "node_id"]).collect()}

    def flat(nodes, path=()):
        for n in nodes:
            assert "nodes" not in n or n["nodes"]
            yield n["title"], path
            yield from flat(n.get("nodes", []), (*path, n["title"]))

    names = {(d, p): t for d, p, _, t, _ in rows}
    for d, nodes in got.items():
        assert list(flat(nodes)) == [(names[d, p], tuple(names[d, a] for a in path)) for (e, p), path in sorted(plain_tree(rows).items()) if e == d]


@pytest.mark.parametrize("overlap,guard", [(1, False), (2, True)])
def test_packing(spark, overlap, guard):
    rng = random.Random(6)
    docs = {d: [rng.randrange(1, 80) for _ in range(rng.randrange(1, 30))] for d in range(25)}
    docs[99] = [500, 3, 500]

    def plain(t):
        if sum(t) <= 100:
            return [(0, len(t) - 1)]
        average = math.ceil((sum(t) / math.ceil(sum(t) / 100) + 100) / 2)
        out, start, n = [], 0, 0
        for i, x in enumerate(t):
            if n + x > average and (start < i or not guard):
                out.append((start, i - 1))
                start = max(i - overlap, 0)
                n = sum(t[start:i])
            n += x
        return [*out, (start, len(t) - 1)]

    df = spark.createDataFrame([(d, i, x) for d, t in docs.items() for i, x in enumerate(t)], "doc_id long, page_no int, token_count int")
    got = {}
    for r in packing.groups(df, 100, overlap, guard).orderBy("doc_id", "group_no").collect():
        got.setdefault(r.doc_id, []).append((r.first, r.last))
    assert got == {d: plain(t) for d, t in docs.items()}


def test_packing_of_empty_and_long_documents(spark, tmp_path):
    from folioscope.queries import QUERIES

    texts = {1: "", 2: None, 3: "\n\n", 4: "x" * 1596 + "\n", 5: ("x" * 400 + "\n") * 30_000, 6: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["group_pack"](spark, str(tmp_path)).orderBy("doc_id", "group_no").collect():
        got.setdefault(r.doc_id, []).append((r.group_no, r.first, r.last))
    assert {d: g for d, g in got.items() if d != 5} == {1: [(0, 0, 0)], 2: [(0, 0, 0)], 3: [(0, 0, 2)], 4: [(0, 0, 1)], 6: [(0, 0, 0)]}
    assert got[5] == [(i, 3 * i, min(3 * i + 3, 30_000)) for i in range(10_000)]
    units = spark.createDataFrame([(1, None, 70), (1, 2, None), (1, 3, 80)], "doc_id long, page_no int, token_count int")
    assert sorted(map(tuple, packing.groups(units, 100).collect())) == [(1, 0, 0, 1), (1, 1, 1, 2)]


def test_blocks_keep_their_rules(spark):
    items = spark.createDataFrame([(1, 1, 1, " ab "), (1, 1, 2, ""), (1, 2, 3, "c "), (1, 2, 4, "Page 1 of 2")], "doc_id long, page_no int, line_num int, text string")
    word = blocks.word_blocks(items.withColumnRenamed("page_no", "section_ordinal")).orderBy("block_no").collect()
    assert [(r.normalized_text, r.char_start_in_doc, r.char_end_in_doc, r.char_start_in_page) for r in word] == [("ab", 0, 1, 0), ("c", 3, 3, 0), ("Page 1 of 2", 5, 15, 2)]
    pdf = blocks.pdf_blocks(items).orderBy("block_no").collect()
    assert [(r.normalized_text, r.char_start_in_doc, r.char_start_in_page) for r in pdf] == [("ab", 0, 0), ("", 3, 3), ("c", 3, 0), ("", 5, 2)]
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id long, page_no int, text string")
    assert blocks.page_text(pages).first().text == "ab"
    assert blocks.page_text(pages, True).first().text.startswith("<physical_index_1>\na\n<physical_index_1>\n\n<physical_index_2>")


def test_repairs_and_calls(spark):
    pages = spark.createDataFrame([(1, i, f"page {i} " + ("Alpha" if i == 3 else "")) for i in range(1, 6)], "doc_id long, page_no int, text string")
    items = spark.createDataFrame([(1, 0, "First", 1, True, 5), (1, 1, "Alpha", 5, False, 5), (1, 2, "Last", 5, True, 5)], "doc_id long, pos int, title string, physical_index int, correct boolean, page_count int")
    stub = enrich.Stub({"On which": '{"physical_index": "<physical_index_3>"}', "page 3 Alpha": '{"answer": "yes"}', "Does": '{"answer": "no"}'})
    got = {r.pos: r for r in enrich.repaired(items, pages, stub).collect()}
    assert got[1].physical_index == 3 and got[1].correct and got[0].physical_index == 1

    class Fails(enrich.Client):
        def generate(self, prompt, json_reply=False):
            raise OSError("down")

    r = enrich.called(pages.limit(1), F.lit("x"), Fails(), attempts=2, pause_s=0).first()
    assert (r.reply, r.status) == ("Error", "error")
    assert enrich.called(pages.limit(1), F.lit(None).cast("string"), Fails(), attempts=1).first().reply is None
    parts = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, group_no int, text string")
    stub = enrich.Stub({"Go on": '{"result": [{"structure": "2", "title": "B", "physical_index": "<physical_index_4>"}]}', "List": '{"result": [{"structure": "1", "title": "A", "physical_index": "<physical_index_1>"}]}'})
    assert [(r.title, r.physical_index) for r in enrich.outlined(parts, stub).orderBy("pos").collect()] == [("A", 1), ("B", 4)]


def test_limiter():
    now, slept = [0.0], []
    limit = enrich.Limiter(2, 60, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(4):
        limit.wait()
        now[0] += 1
    assert slept == [58.0]


def test_options():
    assert index.Options.of({"node_text": "yes", "thinning_tokens": 9}).node_text is True
    with pytest.raises(ValueError):
        index.Options.of({"no_such": 1})
    with pytest.raises(TypeError):
        index.Options.of({"thinning_tokens": "9"})
    with pytest.raises(ValueError):
        enrich.client_of("nobody")


def test_markdown_plan(spark):
    text = "lost\n# A\nalpha\n```\n# no\n```\n## B ##\nbeta\n# C\n####### not"
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    nodes = index.markdown_tree(docs, index.Options(summaries=True), enrich.Stub())
    rows = nodes.orderBy("pos").collect()
    assert [(r.title, r.level, r.line_num, r.parent_pos) for r in rows] == [("A", 1, 2, None), ("B ##", 2, 7, 1), ("C", 1, 9, None)]
    assert rows[1].text == "## B ##\nbeta" and rows[1].summary == rows[1].text and rows[0].prefix_summary == rows[0].text and rows[0].summary is None
    names = docs.select("doc_id", F.lit("d").alias("doc_name"))
    out = json.loads(index.results(nodes, names).first().result)
    assert out["doc_name"] == "d" and [n["title"] for n in out["structure"]] == ["A", "C"] and out["structure"][0]["nodes"][0]["title"] == "B ##"
    assert [r.title for r in index.markdown_tree(docs, index.Options(thinning=True, thinning_tokens=20)).orderBy("pos").collect()] == ["A", "C"]


def docx(body: str) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:r="{r}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="http://t"/></Relationships>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_word_plan(spark, tmp_path):
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{s}\'/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}{p(t)}</w:tc>"
    body = p("before") + p("Head", "H1") + p(" ") + '<w:p><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>' + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>" + p("Sub", "Heading2")
    (tmp_path / "one.docx").write_bytes(docx(body))
    (tmp_path / "two.docx").write_bytes(b"no zip")
    found = files.read_files(spark, str(tmp_path)).withColumn("doc_id", F.when(F.col("doc_name") == "one.docx", 1).otherwise(2).cast("long"))
    items = files.word_items(found)
    assert items.filter("doc_id = 2").first().error
    good = items.filter("doc_id = 1").cache()
    assert [(r.kind, r.level, r.text) for r in good.orderBy("item_no").collect()] == [("text", None, "before"), ("heading", 1, "Head"), ("text", None, "[link](http://t)"), ("text", None, "a | b"), ("heading", 2, "Sub")]
    nodes, blocks_ = index.word_index(good, found.select("doc_id", "doc_name"))
    assert [(r.title, r.pos, r.start_index, r.end_index) for r in nodes.orderBy("pos").collect()] == [("one.docx", 1, 1, 1), ("Head", 2, 2, 3), ("Sub", 3, 3, 3)]
    assert [r.node_id for r in blocks_.orderBy("block_no").collect()] == ["0000", "0001", "0001", "0001", "0002"]


def test_paged_plan(spark):
    pages = spark.createDataFrame([(1, p, n, f"p{p} l{n}") for p in range(1, 7) for n in (1, 2)], "doc_id long, page_no int, line_num int, text string")
    items = spark.createDataFrame([(1, 0, "1", "One", 2, "yes"), (1, 1, "1.1", "Sub", 3, "no"), (1, 2, "2", "Two", 5, "yes")], "doc_id long, pos long, structure string, title string, physical_index int, appear_start string")
    nodes, held = index.paged_index(pages, items, index.Options(node_text=True))
    got = {r.title: (r.start_index, r.end_index, r.node_id) for r in nodes.collect()}
    assert got == {"Preface": (1, 1, "0000"), "One": (2, 4, "0001"), "Sub": (3, 4, "0002"), "Two": (5, 6, "0003")}
    assert [r.node_id for r in held.filter("block_order_in_page = 1").orderBy("page_no").collect()] == ["0000", "0001", "0002", "0002", "0003", "0003"]
    assert outline.within_pages(items, spark.createDataFrame([(1, 2)], "doc_id long, page_count int")).filter("physical_index IS NULL").count() == 2


def test_retrieval(spark):
    nodes = spark.createDataFrame([(1, "0000", "a", 1, 3), (1, "0001", "b", 3, 4)], "doc_id long, node_id string, text string, start_index int, end_index int")
    s = spark.createDataFrame([(1, "tree")], "doc_id long, structure string")
    hints = spark.createDataFrame([("profit", "look at notes"), ("none", "never")], "keyword string, advice string")
    stub = enrich.Stub({"look at notes": 'so: {"thinking": "t", "node_list": ["0001", "0000", "9"]}'})
    chosen = search.tree_search(s, "What profit?", stub, hints)
    assert search.assembled(nodes, chosen).first().context == "b\n\na"
    assert [r.page_no for r in search.pages_of(nodes, chosen).orderBy("rank").collect()] == [3, 4, 1, 2]
    assert search.tree_search(s, "What?", enrich.Stub()).count() == 0
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, doc_name string, doc_description string")
    assert [r.doc_id for r in search.search_description(docs, "q", enrich.Stub({"1 | a | x": '{"answer": [2, 7]}'})).collect()] == [2]
    assert search.fenced_pages(spark.createDataFrame([("no fence",)], "reply string")).count() == 0


def test_tables(spark):
    df = spark.createDataFrame([([[" a ", None], [" ", ""], ["x|y", "1\n2", "z"]],), ([],), ([[]],)], "cells array<array<string>>")
    rows = df.select(T.normalize_table(F.col("cells")).alias("n"), T.markdown_table(F.col("cells")).alias("m"), T.structure_key(F.col("cells")).alias("k"), T.normalize_rows(F.col("cells")).alias("r")).collect()
    assert rows[0].n == [["a", "", ""], ["x|y", "1\n2", "z"]] and rows[1].n == [] and rows[2].n == []
    assert rows[0].m.split("\n")[-1] == "| x\\|y | 1 2 | z |" and rows[1].m == "" and rows[2].m == ""
    assert (rows[0].k.columns, rows[0].k.first) == (3, ["a", ""]) and (rows[1].k.columns, rows[1].k.first) == (0, [])
    one = spark.range(1).select(
        T.table_title(F.lit("\n 《A， b》\nmore")).alias("t"), T.table_title(F.lit("。")).alias("e"), T.one_line(F.lit(" a \n b ")).alias("o"),
        T.overlap(F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0))), F.array(*map(F.lit, (5.0, 5.0, 20.0, 20.0)))).alias("v"),
        T.at_top(F.lit(None).cast("array<double>"), F.lit(10.0)).alias("n"), X.tokens(F.lit("")).alias("z"), X.tokens(F.lit("ab")).alias("w"), X.preview(F.lit("x" * 41)).alias("p"),
        X.header_file_name(F.lit('attachment; filename="a.pdf"'), F.lit("http://x/b.pdf?c")).alias("h"), X.url_file_name(F.lit("http://x/")).alias("u"), X.is_qwen(F.lit("a/qwen2")).alias("q"),
    ).first()
    assert (one.t, one.e, one.o, one.v, one.n, one.z, one.w, one.p) == ("A b", "表格", "a b", 0.25, False, 0, 1, "x" * 40 + "...")
    assert (one.h, one.u, one.q) == ("a.pdf", "remote-file.bin", True)
    with pytest.raises(Exception, match="unsupported file type"):
        spark.range(1).select(X.file_type(F.lit("a.exe"))).collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ask = [{"task_id": "a", "callback_url": "u", "file_path": "f", "requested_at": "2024-01-01T00:00:00Z"}, {"task_id": "a", "callback_url": "u", "file_path": "f", "requested_at": "2024-01-01T00:00:01Z"}, {"task_id": "b", "callback_url": "u", "requested_at": "2024-01-01T00:00:02Z"}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, ask)))
    for _ in range(2):  # a second run takes nothing twice
        tasks.run_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), lambda d: d.withColumn("error", F.lit(None).cast("string"))).awaitTermination()
    events = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.task_id, r.stage) for r in tasks.latest(events).collect()} == {("a", "completed"), ("b", "failed")} and events.count() == 6


def test_callback_retries():
    tried, slept = [], []

    def send(url, payload):
        tried.append(url)
        if len(tried) < 3:
            raise OSError

    assert tasks.post("u", {}, send=send, sleep=slept.append) == 3 and slept == [1, 2]
    with pytest.raises(ZeroDivisionError):
        tasks.post("u", {}, send=lambda *_: 1 / 0, sleep=slept.append)


def test_sinks(spark, tmp_path):
    b = spark.createDataFrame([(1, "a", "f", 1, 1), (1, None, "f", 1, 2), (1, "", "f", 1, 3)], "doc_id long, attachment_id string, file_name string, page_no int, block_no int")
    assert [r.block_no for r in export.content_images(b).collect()] == [1]
    export.write_results(spark.createDataFrame([('{"a":1}',)], "result string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().a == 1


def test_box_queries_take_every_box(spark, tmp_path):
    from folioscope.queries import QUERIES

    rng = random.Random(12)
    docs = [1, 2, 2000, 2001, 9000, 9001, 5_000_000]
    items = [(d, p, float(rng.randrange(1, 51)), rng.randrange(0, 9) / 100) for d in docs for p in range(1, 8)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(d,) for d in docs if d != 9001], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")

    def covered(d, p, x, y):
        if d == 9001 or (p % 3 == 0 and d % 2):
            return False
        return max(0, min(x + 10, 40) - max(x, 10)) * max(0, min(y + 5, 7) - max(y, 1)) / 50 > 0.3

    kept = sorted((d, p) for d, p, x, t in items if not covered(d, p, x, t * 100))
    got = sorted(map(tuple, QUERIES["bbox_suppress"](spark, str(tmp_path)).collect()))
    assert got == kept and 0 < len(kept) < len(items) and max(d for d, _ in got) == 5_000_000
    order = []
    for d in docs:
        rows = sorted((i for i in items if i[0] == d), key=lambda i: (i[1] == 2, round(i[3] * 100, 2) if i[1] != 2 else 0, i[2] if i[1] != 2 else 0, i[1]))
        order += [(d, i[1], n) for n, i in enumerate(rows, 1)]
    assert sorted(map(tuple, QUERIES["page_order"](spark, str(tmp_path)).collect())) == sorted(order)


def test_html_items_query_is_its_sql(spark, tmp_path):
    import duckdb

    from folioscope.queries import QUERIES, SQL

    pages = [
        "<h1>a &quot;b&quot; &amp;amp; &lt;c&gt; &#39;d&nbsp;</h1><ul><li>x</li></ul>", None, "", "no tags", "<h1>only</h1>", "<ul><li>a<li class='x'>b", "<H1>A</H1><LI>x</LI><li\n>y",
        "<h1 id='x'>a</h1><h1>b<b>c</b></h1><h1>d</h1><h1>e</h1>", "<!-- <h1>in</h1><li> --><h1>out</h1>", "<script>'<li>'</script><h1>\n\u00a0 t\t</h1>", "<h1>\u3000 \u00a0s \u2003</h1><lio><li>",
        "<h1>a<p>b</h1><h1>c</h1>", "<h1></h1><h1>x</h1>", "<h1>x</h1", "<<h1>y</h1><<li >", "<h2>z</h2><h3>q</h3><td>u</td><p>v<li>", "</h1><h1>p > q</h1>",
    ]
    rows = [(i, "u", html) for i, html in enumerate(pages)] + [(3, "u", "<h1>again</h1><li>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(f"WITH pages AS (FROM '{tmp_path}/pages.parquet/*.parquet') {SQL['html_items']}").fetchall()
    got = QUERIES["html_items"](spark, str(tmp_path))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect()) and len(want) == len(rows)
    assert got.dtypes == [("page_id", "bigint"), ("h1", "string"), ("items", "bigint")]
    item = files.html_items(spark.createDataFrame([(1, "<h1> a &quot;<b>b</b> </h1>")], "page_id long, html string")).first()
    assert (item.text, item.raw) == ('a "b', " a &quot;<b>b</b> ")


def test_page_offsets_are_dealt_by_size(spark, tmp_path, monkeypatch):
    import datetime

    import duckdb

    from folioscope import queries as Q

    rng, day = random.Random(13), datetime.datetime(2024, 1, 1)
    orders = [(d, day + datetime.timedelta(rng.randrange(9))) for d in range(3000)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(d, p, at + datetime.timedelta(rng.randrange(-3, 9))) for d, at in orders for p in range(1, rng.randrange(2, 9))], "l_orderkey long, l_linenumber int, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    views = ", ".join(f"{t} AS (FROM '{tmp_path}/{t}.parquet/*.parquet')" for t in ("lineitem", "orders"))
    want = sorted(duckdb.sql(Q.SQL["page_offset_mode"].replace("WITH ", f"WITH {views}, ", 1)).fetchall())
    parts = []
    for size in (4000, 2000):
        monkeypatch.setattr(Q, "PART_BYTES", size)
        got = Q.QUERIES["page_offset_mode"](spark, str(tmp_path))
        parts.append(got.rdd.getNumPartitions())
        assert sorted(map(tuple, got.collect())) == want and len(want) > 2900
    assert parts[0] > 4 and abs(parts[1] - 2 * parts[0]) <= 1
