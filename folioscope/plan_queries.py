"""Registered queries of plans, replies and small operators, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import tables as T
from folioscope.functions import text as X
from folioscope.operators import blocks as B
from folioscope.operators import enrich, export, link, outline, packing, search, tree, word_tables
from folioscope.plans import align, index, resolve
from folioscope.queries import _MD, _PATHS, _TREE, _TURNS, SQL, items, longs, markdown, query, read, requests, turn_tree
from folioscope.streaming import tasks


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text")


@query("""SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY turn) AS plain,
  string_agg('<physical_index_' || (turn + 1) || '>' || chr(10) || text || chr(10) || '<physical_index_' || (turn + 1) || '>' || chr(10) || chr(10), '' ORDER BY turn) AS tagged FROM conversations GROUP BY conv_id""")
def page_texts(spark, sf_dir):
    p = talk(spark, sf_dir)
    return B.page_text(p).withColumnRenamed("text", "plain").join(B.page_text(p, True).withColumnRenamed("text", "tagged"), "doc_id")


@query("SELECT conv_id AS doc_id, turn AS pos, CASE WHEN turn + conv_id % 3 <= 4 THEN turn + conv_id % 3 END AS physical_index FROM conversations")
def page_shift(spark, sf_dir):
    """Printed pages with an offset of each document, null after its last page."""
    i = items(spark, sf_dir).drop("physical_index").withColumn("page", F.col("pos"))
    docs = i.select("doc_id").distinct()
    moved = outline.shifted(i, docs.withColumn("page_offset", F.col("doc_id") % 3))
    return outline.within_pages(moved, docs.withColumn("page_count", F.lit(4))).select("doc_id", "pos", "physical_index")


@query("""WITH b AS (SELECT conv_id AS doc_id, turn + 1 AS block_no, turn // 2 + 1 AS page_no FROM conversations)
SELECT n.doc_id, n.block_no AS pos, s.page_no AS start_index, e.page_no AS end_index FROM b n LEFT JOIN b s ON s.doc_id = n.doc_id AND s.block_no = n.block_no LEFT JOIN b e ON e.doc_id = n.doc_id AND e.block_no = n.block_no + 1""")
def block_page_rewrite(spark, sf_dir):
    b = read(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "turn + 1 AS block_no", "turn DIV 2 + 1 AS page_no")
    nodes = b.selectExpr("doc_id", "block_no AS pos", "block_no AS start_block", "block_no + 1 AS end_block")
    return link.block_pages(nodes, b).select("doc_id", "pos", "start_index", "end_index")


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT doc_id, pos, title AS crumbs FROM p WHERE parent_pos IS NULL UNION ALL SELECT p.doc_id, p.pos, r.crumbs || ' > ' || p.title FROM p JOIN r ON p.doc_id = r.doc_id AND p.parent_pos = r.pos) SELECT doc_id, pos, crumbs FROM r")
def breadcrumbs(spark, sf_dir):
    return tree.breadcrumb(turn_tree(spark, sf_dir)).select("doc_id", "pos", F.array_join("crumbs", " > ").alias("crumbs"))


@query("SELECT l_orderkey AS doc_id, l_returnflag AS attachment_id, 'f' || l_linenumber AS file_name, l_linenumber AS page_no, l_linenumber + 10 AS block_no FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus <> 'O'")
def content_images(spark, sf_dir):
    b = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "nullif(l_returnflag, 'A') AS attachment_id", "IF(l_linestatus = 'O', '', concat('f', l_linenumber)) AS file_name", "l_linenumber AS page_no", "l_linenumber + 10 AS block_no")
    return export.content_images(b)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'remote-file.bin' ELSE 'f' || p_partkey || '.pdf' END AS url_name,
  CASE WHEN p_partkey % 2 = 0 THEN 'n' || p_partkey || '.docx' WHEN p_partkey % 3 = 0 THEN 'remote-file.bin' ELSE 'f' || p_partkey || '.pdf' END AS header_name,
  CASE p_partkey % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'gif' END AS ext, CASE p_partkey % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' ELSE 'image/gif' END AS kind,
  replace(p_type || '/' || p_brand, '/', '-') AS safe, CASE WHEN length(p_name) > 5 THEN left(p_name, 5) || '...' ELSE p_name END AS shown,
  p_partkey % 4 < 2 AS qwen, CASE WHEN p_partkey % 5 = 0 THEN 'gpt-4o' ELSE 'm' || p_partkey END AS model,
  CASE WHEN p_partkey % 2 = 0 THEN 7 ELSE -1 END AS first_tag, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -1 END AS last_tag FROM part""")
def scalar_names(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    url = F.when(F.col("p_partkey") % 3 == 0, F.lit("http://h/")).otherwise(F.concat(F.lit("http://h/a/f"), k, F.lit(".pdf?x=1#y")))
    tags = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a<start_index_7>b <start_index_"), F.col("p_size").cast("string"), F.lit(">"))).otherwise(F.lit("start_index_3"))
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        X.url_file_name(url).alias("url_name"),
        X.header_file_name(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('attachment; FileName="n'), k, F.lit('.docx"'))), url).alias("header_name"),
        X.image_extension(F.element_at(F.array(*map(F.lit, (".JPG", "PNG", ".gif"))), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("ext"),
        X.content_type(F.element_at(F.array(*map(F.lit, ("jpg", ".png", "GIF"))), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("kind"),
        X.safe_name(F.concat("p_type", F.lit("/"), "p_brand")).alias("safe"),
        X.preview(F.col("p_name"), 5).alias("shown"),
        X.is_qwen(F.element_at(F.array(*map(F.lit, ("Qwen2", "org/qwen-7b", "gpt-4o", "myqwen"))), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("qwen"),
        X.model_name(F.when(F.col("p_partkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" m"), k))).alias("model"),
        X.first_start(tags).alias("first_tag"),
        X.last_start(tags).alias("last_tag"),
    )


@query("""SELECT n_nationkey, '**' || n_name || '**' || chr(10) || chr(10) || '| a |' || CASE WHEN n_regionkey = 0 THEN '' ELSE chr(10) || chr(10) || 'sum of ' || n_name END AS block,
  n_nationkey % 2 = 0 AS has_box, 'a ' || n_name AS line, left('a ' || n_name, 4) AS cut FROM nation""")
def table_blocks(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    corners = F.when(F.col("n_nationkey") % 2 == 0, F.array(*map(F.lit, (1, 2, 3, 4)))).otherwise(F.array(*map(F.lit, (1, 2, 3))))
    loose = F.concat(F.lit(" a \n\t "), "n_name", F.lit("  "))
    return n.select("n_nationkey", T.table_block(F.lit("| a |"), F.col("n_name"), F.when(F.col("n_regionkey") != 0, F.concat(F.lit("sum of "), "n_name"))).alias("block"), T.box(corners).isNotNull().alias("has_box"), T.one_line(loose).alias("line"), T.one_line(loose, 4).alias("cut"))


@query("""SELECT n_nationkey, n_nationkey % 3 = 0 AS said_yes, n_nationkey % 2 = 0 AS header, x.structure, x.title, x.page, x.physical_index
FROM nation, (VALUES ('1', 'A', '3', NULL), ('1.1', 'B', NULL, '<physical_index_4>')) x(structure, title, page, physical_index)""")
def json_replies(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    said = F.element_at(F.array(*map(F.lit, ('Sure: {"answer": "Yes"} done', '{"answer": "no"}', "not json"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    head = F.when(F.col("n_nationkey") % 2 == 0, F.lit('{"is_header": true}')).otherwise(F.lit('{"is_header": "maybe"}'))
    listed = F.lit('```json\n{"result": [{"structure": "1", "title": "A", "page": "3"}, {"structure": "1.1", "title": "B", "physical_index": "<physical_index_4>"}]}\n```')
    return n.select("n_nationkey", enrich.yes(said).alias("said_yes"), enrich.yes(head, "is_header").alias("header"), F.inline(enrich.outline_items(listed)))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_count FROM documents WHERE length(text) // 4 > 500")
def over_limit(spark, sf_dir):
    return tree.token_limit(read(spark, sf_dir, "documents"), 500).select("doc_id", "token_count")


@query("SELECT doc_id, doc_id % 30 AS pages FROM documents WHERE doc_id % 30 > 20 AND n_chars >= 512")
def oversized_nodes(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr("doc_id", "1 AS start_index", "1 + doc_id % 30 AS end_index", "n_chars AS token_count")
    return tree.oversized(d, 20, 512).select("doc_id", (F.col("end_index") - 1).alias("pages"))


@query(f"WITH {_TURNS} SELECT doc_id, printf('%04d', CAST(count(*) - 1 AS INTEGER)) AS node_id, arg_max(title, pos) AS title FROM n GROUP BY doc_id")
def last_nodes(spark, sf_dir):
    return tree.last_node(turn_tree(spark, sf_dir))


@query("""SELECT CAST(event_id AS VARCHAR) AS task_id, CASE WHEN event_id % 9 = 0 THEN 'task_id is required' WHEN event_id % 9 = 1 THEN 'callback_url is required' WHEN event_id % 9 = 2 THEN 'a file or a remote file is required'
  WHEN event_id % 9 = 3 THEN 'a file and a remote file exclude each other' WHEN event_id % 9 = 4 THEN 'index_options is no JSON object' END AS error FROM events""")
def task_requests(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("k", F.col("task_id").cast("long") % 9)
    r = r.withColumns({"file_path": F.when(F.col("k") != 2, F.lit("f.md")), "remote_url": F.when(F.col("k") == 3, F.lit("http://f")), "callback_url": F.when(F.col("k") != 1, F.lit("http://c")), "index_options": F.when(F.col("k") == 4, F.lit("[1")).otherwise(F.lit('{"a": "b"}'))})
    checked = tasks.checked(r.withColumn("own", F.col("task_id")).withColumn("task_id", F.when(F.col("k") == 0, F.lit(" ")).otherwise(F.col("task_id"))))
    return checked.select(F.col("own").alias("task_id"), "error")


@query("SELECT event_id, round(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS waited_s FROM events")
def task_durations(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("user_id AS task_id", "ts", "event_id AS seq")
    return tasks.durations(e).select(F.col("seq").alias("event_id"), F.round("waited_s", 3).alias("waited_s"))


@query("SELECT DISTINCT conv_id AS doc_id, CASE conv_id % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'two' END AS doc_description, 'said ' || conv_id % 3 AS answer FROM conversations")
def described_docs(spark, sf_dir):
    """Descriptions and answers as a stub gives them."""
    s = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct().withColumn("structure", F.concat(F.lit("tree "), (F.col("doc_id") % 3).cast("string"), F.lit(".")))
    told = enrich.described(s, enrich.Stub({"tree 0.": "zero", "tree 1.": "one", "tree 2.": "two"})).withColumnRenamed("structure", "context")
    return search.answered(told, "which?", enrich.Stub({f"tree {i}.": f"said {i}" for i in range(3)})).select("doc_id", "doc_description", "answer")


@query("SELECT item_id AS doc_id FROM benchmark WHERE item_id IN (2, 3, 5)")
def description_search(spark, sf_dir):
    d = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("n").alias("doc_name"), F.left("text", F.lit(9)).alias("doc_description"))
    return search.search_description(d, "which?", enrich.Stub({"which?": 'I say {"thinking": "t", "answer": [2, 3, 5, 999999]}'}))


@query("SELECT conv_id AS doc_id, turn + 1 AS pos, CASE WHEN role = 'user' OR turn > 0 THEN 'main' ELSE 'main' END AS said FROM conversations")
def summaries_all(spark, sf_dir):
    """Without a threshold every node is asked about, leaves and inner nodes alike."""
    n = turn_tree(spark, sf_dir)
    told = enrich.summarised(n, enrich.Stub({"main points": "main"}), None)
    return told.select("doc_id", "pos", F.coalesce("summary", "prefix_summary").alias("said"))


#: Printed contents of six pages by region: three sections on pages 3, 4 and 5; region 3 prints a wrong page, region 4 has no contents, region 2 no numbers.
_LIST = {True: "alpha........1\nbeta........2\ngamma........{}", False: "alpha\nbeta\ngamma"}


def booklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = F.when(F.col("r_regionkey") == 4, F.lit("a picture")).when(F.col("r_regionkey") == 2, F.lit("CONTENTS bare\n" + _LIST[False])).otherwise(
        F.concat(F.lit("CONTENTS\n"), F.replace(F.lit(_LIST[True]), F.lit("{}"), F.when(F.col("r_regionkey") == 3, F.lit("5")).otherwise(F.lit("3"))))
    )
    texts = [F.lit("cover"), contents, F.lit("# alpha-section"), F.lit("more\n# beta-section"), F.lit("# gamma-section"), F.lit("end")]
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.posexplode(F.array(*texts)).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page_no"), "text")


def reader() -> enrich.Client:
    names = ("alpha", "beta", "gamma")
    listed = lambda last: '{"result": [{"structure": "1", "title": "alpha", "page": "1"}, {"structure": "2", "title": "beta", "page": "2"}, {"structure": "3", "title": "gamma", "page": "' + last + '"}]}'
    found = '{"result": [' + ", ".join(f'{{"structure": "{i}", "title": "{n}", "physical_index": "<physical_index_{i + 2}>"}}' for i, n in enumerate(names, 1)) + "]}"
    rules = [(("hold a table of contents", "CONTENTS"), '{"answer": "yes"}'), (("give page numbers", ": 1"), '{"answer": "yes"}'), (("hold every entry",), '{"answer": "yes"}')]
    rules += [(("Turn this", ": 5"), listed("5")), (("Turn this", ": 3"), listed("3")), (("Turn this",), listed(""))]
    rules += [((f"titled {n} appear", f"{n}-section"), '{"answer": "yes"}') for n in names]
    rules += [((f"start with a section titled {n}?", f"# {n}-section"), '{"answer": "yes"}') for n in ("alpha", "gamma")]
    rules += [(("which tagged page does the section titled gamma",), '{"physical_index": "<physical_index_5>"}')]
    rules += [(("On which tagged page does this entry", f'"{n}"', f"{n}-section"), f'{{"physical_index": "<physical_index_{i}>"}}') for i, n in enumerate(names, 3)]
    rules += [(("Which printed page", f'"{n}"'), f'{{"page": {i}}}') for i, n in enumerate(names, 1)]
    rules += [(("List the sections",), found), (("Go on with these",), '{"result": []}')]
    return enrich.Rules(rules)


@query("SELECT r_regionkey AS doc_id, 2 AS start, 2 AS \"end\", 1 AS pages FROM region WHERE r_regionkey <> 4")
def contents_runs(spark, sf_dir):
    return longs(resolve.contents_run(booklets(spark, sf_dir), reader(), 3), "doc_id", "pages")


@query("SELECT r_regionkey AS doc_id, i.pos, i.structure, i.title, CASE WHEN i.pos = 2 AND r_regionkey = 3 THEN 5 ELSE i.page END AS page, CASE WHEN r_regionkey = 3 AND i.pos = 2 THEN 7 ELSE i.page + 2 END AS physical_index FROM region, (VALUES (0, '1', 'alpha', 1), (1, '2', 'beta', 2), (2, '3', 'gamma', 3)) i(pos, structure, title, page) WHERE r_regionkey NOT IN (2, 4)")
def contents_entries(spark, sf_dir):
    """Numbered contents as entries with the physical page that the most frequent offset gives."""
    p, model = booklets(spark, sf_dir), reader()
    found = resolve.contents_items(resolve.contents_text(p, resolve.contents_run(p, model, 3)), model)
    return resolve.by_offset(found, p, model).select("doc_id", "pos", "structure", "title", "page", "physical_index")


@query("SELECT CAST(2 AS BIGINT) AS doc_id, i.pos, i.structure, i.title, i.pos + 3 AS physical_index FROM (VALUES (0, '1', 'alpha'), (1, '2', 'beta'), (2, '3', 'gamma')) i(pos, structure, title)")
def toc_alignment(spark, sf_dir):
    """Contents without page numbers: entries are looked for on the tagged pages."""
    p, model = booklets(spark, sf_dir), reader()
    bare = resolve.unnumbered_items(resolve.contents_text(p, resolve.contents_run(p, model, 3)), model)
    return align.located(bare, p, model).select("doc_id", "pos", "structure", "title", "physical_index")


@query("SELECT r_regionkey AS doc_id, i.pos, i.title, i.pos + 1 AS page FROM region, (VALUES (0, 'alpha'), (1, 'beta'), (2, 'gamma')) i(pos, title)")
def printed_pages(spark, sf_dir):
    docs = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"))
    listed = docs.select("doc_id", F.posexplode(F.array(*map(F.lit, ("alpha", "beta", "gamma")))).alias("pos", "title")).withColumn("structure", F.lit("1"))
    texts = docs.withColumns({"group_no": F.lit(0), "text": F.lit("the contents")})
    return align.printed_pages(listed, texts, reader()).select("doc_id", "pos", "title", "page")


@query("SELECT r_regionkey AS doc_id, i.pos, i.title, i.page FROM region, (VALUES (0, 'one', 1), (1, 'two', 2), (2, 'three', 3)) i(pos, title, page)")
def toc_continue(spark, sf_dir):
    """A list that breaks off in the second entry is gone on with until it is complete."""
    texts = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("contents of "), "r_name").alias("text"))
    rules = [(("hold every entry", '"three"'), '{"answer": "yes"}'), (("Turn this",), '{"result": [{"structure": "1", "title": "one", "page": "1"}, {"structure": "2", "ti')]
    rules += [(("Go on with this JSON",), '{"structure": "2", "title": "two", "page": "2"}, {"structure": "3", "title": "three", "page": "3"}]}')]
    return align.entries(texts, enrich.Rules(rules)).select("doc_id", "pos", "title", "page")


@query("""SELECT r_regionkey AS doc_id, i.pos, i.structure, i.title, i.pos + 3 AS physical_index, CASE WHEN i.pos = 1 OR (i.pos = 2 AND r_regionkey = 3) THEN 'no' ELSE 'yes' END AS appear_start,
  CASE WHEN r_regionkey = 4 THEN 'no contents' WHEN r_regionkey = 2 THEN 'contents without pages' ELSE 'contents' END AS mode FROM region, (VALUES (0, '1', 'alpha'), (1, '2', 'beta'), (2, '3', 'gamma')) i(pos, structure, title)""")
def outline_resolution(spark, sf_dir):
    """All modes, checks and the repair of one wrong entry."""
    found, status = resolve.resolved(booklets(spark, sf_dir), reader())
    return found.join(status.select("doc_id", "mode"), "doc_id").select("doc_id", "pos", "structure", "title", "physical_index", "appear_start", "mode")


@query("SELECT r_regionkey AS doc_id, '0000' AS parent_id, i.pos, i.title, i.pos + 3 AS physical_index FROM region, (VALUES (1, 'beta'), (2, 'gamma')) i(pos, title)")
def expanded_nodes(spark, sf_dir):
    """A node that is too large gets an outline of its own, without the title that repeats its own."""
    nodes = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit("0000").alias("node_id"), F.lit("alpha").alias("title"), F.lit(1).alias("start_index"), F.lit(6).alias("end_index"), F.lit(900).alias("token_count"))
    return resolve.expanded(nodes, booklets(spark, sf_dir), reader(), 3, 500).select("doc_id", "parent_id", "pos", "title", "physical_index")


@query("SELECT r_regionkey AS doc_id, i.pos, i.title, i.n AS start_block_no FROM region, (VALUES (0, 'a', 2), (2, 'c', 4), (3, 'd', 5)) i(pos, title, n)")
def block_outline(spark, sf_dir):
    """Outline items over blocks: those out of the blocks or not rising are left out."""
    b = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("block_no")).withColumns({"normalized_text": F.lit("x"), "token_count": F.lit(1)})
    said = ", ".join(f'{{"structure": "1", "title": "{t}", "physical_index": "<block_{n}>"}}' for t, n in (("a", 2), ("b", 1), ("c", 4), ("d", 5), ("e", 9)))
    return resolve.block_outline(b, enrich.Rules([(("List",), f'{{"result": [{said}]}}')])).select("doc_id", "pos", "title", "start_block_no")


@query("""SELECT r_regionkey AS doc_id, 0 AS row_no, 'text' AS kind, CAST(NULL AS INTEGER) AS level, 'name | value' || chr(10) || 'x | 1' || chr(10) || 'y | ' AS text FROM region WHERE r_regionkey % 2 = 1
UNION ALL SELECT r_regionkey, v.n, v.kind, CASE WHEN v.kind = 'heading' THEN 3 END, CASE WHEN v.kind = 'heading' THEN v.name ELSE '路径: ' || r_name || ' > ' || v.name || chr(10) || 'name: ' || v.name || v.rest END
FROM region, (VALUES (0, 'heading', 'x', ''), (0, 'text', 'x', chr(10) || 'value: 1'), (1, 'heading', 'y', ''), (1, 'text', 'y', '')) v(n, kind, name, rest) WHERE r_regionkey % 2 = 0""")
def field_tables(spark, sf_dir):
    """Rows of tables as sections where the model says so, else one text."""
    cell = lambda *c: F.array(*(F.lit(x) for x in c))
    t = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit(1).alias("item_no"), F.array(cell("name", F.when(F.col("r_regionkey") % 2 == 0, "value").otherwise("value")), cell("x", "1"), cell("y", "")).alias("cells"), F.array("r_name").alias("crumbs"), F.lit(2).alias("level"), F.col("r_regionkey"))
    yes, no = enrich.Stub({"Should": '{"expand": true, "name_column_index": 9}'}), enrich.Stub({"Should": '{"expand": false}'})
    rows = word_tables.expanded_tables(t.filter("r_regionkey % 2 = 0").drop("r_regionkey"), yes).unionByName(word_tables.expanded_tables(t.filter("r_regionkey % 2 = 1").drop("r_regionkey"), no))
    return rows.select("doc_id", "row_no", "kind", "level", "text")


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH {_MD}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_num) AS pos, lead(line_num) OVER (PARTITION BY doc_id ORDER BY line_num) AS nxt FROM h WHERE level IS NOT NULL),
t AS (SELECT n.doc_id, n.pos, n.level, n.title, n.line_num, {_STRIP.format("string_agg(l.t, chr(10) ORDER BY l.line_num)")} AS text FROM n JOIN l ON l.doc_id = n.doc_id AND l.line_num >= n.line_num AND l.line_num < coalesce(n.nxt, 1000000) GROUP BY ALL)
SELECT doc_id, pos, title, line_num, (SELECT max(m.pos) FROM t m WHERE m.doc_id = t.doc_id AND m.pos < t.pos AND m.level < t.level) AS parent_pos, printf('%04d', CAST(pos - 1 AS INTEGER)) AS node_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_count FROM t""")
def markdown_index(spark, sf_dir):
    return longs(index.markdown_tree(markdown(spark, sf_dir)).select("doc_id", "pos", "title", "line_num", "parent_pos", "node_id", "token_count"), "pos", "line_num", "parent_pos")


@query("""WITH c AS (SELECT conv_id AS doc_id, turn + 1 AS item_no, role = 'user' AS head, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) + CASE WHEN first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' THEN 0 ELSE 1 END AS s FROM conversations)
SELECT doc_id, CAST(s AS INTEGER) AS pos, coalesce(max(CASE WHEN head THEN text END), 'conversation-' || doc_id) AS title, CAST(min(item_no) AS BIGINT) AS line_num, coalesce(string_agg(CASE WHEN NOT head THEN text END, chr(10) || chr(10) ORDER BY item_no), '') AS text, printf('%04d', CAST(s - 1 AS INTEGER)) AS node_id, CAST(s AS INTEGER) AS start_index, CAST(s AS INTEGER) AS end_index FROM c GROUP BY doc_id, s""")
def word_nodes(spark, sf_dir):
    """Sections of body items: those before the first heading stand under the document's name."""
    i = read(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "turn + 1 AS item_no", "IF(role = 'user', 'heading', 'text') AS kind", "IF(role = 'user', 1, NULL) AS level", "text", "'p' AS source")
    names = i.select("doc_id").distinct().withColumn("doc_name", F.concat(F.lit("conversation-"), F.col("doc_id").cast("string")))
    nodes, _ = index.word_index(i, names)
    return nodes.select("doc_id", "pos", "title", "line_num", "text", "node_id", "start_index", "end_index")


@query("""WITH RECURSIVE u AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CAST(greatest(1, length(text) // 4) AS BIGINT) AS n, count(*) OVER (PARTITION BY conv_id) AS c, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id) AS total FROM conversations),
z AS (SELECT *, ceil((total / ceil(total / 60.0) + 60) / 2) AS average FROM u),
r AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS start, n AS held, CAST(0 AS BIGINT) AS g, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS l FROM z WHERE i = 0
  UNION ALL SELECT z.doc_id, z.i, CASE WHEN r.held + z.n > z.average AND r.start < z.i THEN z.i - 1 ELSE r.start END, CASE WHEN r.held + z.n > z.average AND r.start < z.i THEN p.n + z.n ELSE r.held + z.n END,
    CASE WHEN r.held + z.n > z.average AND r.start < z.i THEN r.g + 1 ELSE r.g END, CASE WHEN r.held + z.n > z.average AND r.start < z.i THEN r.start END, CASE WHEN r.held + z.n > z.average AND r.start < z.i THEN z.i - 1 END
  FROM r JOIN z ON z.doc_id = r.doc_id AND z.i = r.i + 1 JOIN z p ON p.doc_id = r.doc_id AND p.i = r.i),
g AS (SELECT r.doc_id, r.g - 1 AS group_no, f AS first, l AS last FROM r JOIN z USING (doc_id, i) WHERE f IS NOT NULL AND total > 60 UNION ALL SELECT r.doc_id, r.g, r.start, z.c - 1 FROM r JOIN z USING (doc_id, i) WHERE z.i = z.c - 1 AND total > 60 UNION ALL SELECT doc_id, 0, 0, c - 1 FROM z WHERE i = 0 AND total <= 60)
SELECT doc_id, group_no, first, last FROM g""")
def group_pack_turns(spark, sf_dir):
    u = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), F.greatest(F.lit(1), F.floor(F.length("text") / 4).cast("int")).alias("token_count"))
    return longs(packing.groups(u, 60, 1, True, "block_no"), "group_no", "first", "last")


_REACH = f"{_PATHS}, q AS (SELECT p.doc_id, p.pos, p.pos AS a, least(p.subtree_end, p.pos + CASE p.level WHEN 1 THEN 9 WHEN 2 THEN 2 ELSE 1 END) AS b, p.parent_pos FROM p)"


#: The node at which a descent from the roots ends, for each place.
SQL["link_first_match"] = f"""{_REACH}, s AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS place FROM q),
w AS (SELECT s.doc_id, s.place, CAST(NULL AS BIGINT) AS node, 0 AS step FROM s UNION ALL
  SELECT w.doc_id, w.place, (SELECT coalesce(min(CASE WHEN EXISTS (SELECT 1 FROM q k WHERE k.doc_id = c.doc_id AND k.parent_pos = c.pos AND w.place BETWEEN k.a AND k.b) THEN c.pos END), max(c.pos)) FROM q c WHERE c.doc_id = w.doc_id AND c.parent_pos IS NOT DISTINCT FROM w.node AND w.place BETWEEN c.a AND c.b), w.step + 1
  FROM w WHERE EXISTS (SELECT 1 FROM q c WHERE c.doc_id = w.doc_id AND c.parent_pos IS NOT DISTINCT FROM w.node AND w.place BETWEEN c.a AND c.b))
SELECT doc_id, place, printf('%04d', CAST(arg_max(node, step) - 1 AS INTEGER)) AS node_id FROM w WHERE node IS NOT NULL GROUP BY doc_id, place"""
