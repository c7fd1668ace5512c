"""Retrieval over indexes: scored documents, tree search, contexts, page selection and metadata queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.operators.enrich import Client, called, prompt_of

SEARCH = "struct<thinking:string,node_list:array<string>>"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def doc_scores(chunks: DataFrame, query: list[float], k: int, doc: str = "doc_id", chunk: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """doc, doc_score, matched: over the k nearest chunks by cosine, the sum of a document's scores / sqrt(matched + 1)."""
    q = F.array(*(F.lit(float(x)) for x in query))
    near = chunks.select(doc, chunk, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), chunk).limit(k)
    return near.groupBy(doc).agg((F.sum("score") / F.sqrt(F.count(F.lit(1)) + 1)).alias("doc_score"), F.count(F.lit(1)).alias("matched"))


def search_metadata(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """A query over metadata tables by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def node_lists(replies: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, place, node_id from replies {"thinking", "node_list"}; other replies select nothing."""
    parsed = F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), SEARCH)
    return replies.select(doc, F.posexplode(parsed["node_list"]).alias("place", "node_id"))


def tree_search(structures: DataFrame, query: str, client: Client, preferences: DataFrame | None = None) -> DataFrame:
    """doc_id, place, node_id that the model names for each structure (doc_id, structure).

    preferences: (keyword, advice) rows; the advice of keywords that the question holds joins the prompt.
    """
    hints = ""
    if preferences is not None:
        held = preferences.filter(F.contains(F.lower(F.lit(query)), F.lower("keyword"))).orderBy("keyword", "advice").collect()  # advice on one question
        hints = "".join(f"\nPreference: {r['advice']}" for r in held)
    prompt = prompt_of("tree_search", query=F.lit(query), preferences=F.lit(hints), text=F.col("structure"))
    return node_lists(called(structures, prompt, client, True))


def assembled(nodes: DataFrame, chosen: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """doc, context: the texts of the chosen nodes (doc, place, node_id) in the order of the list, parted by blank lines."""
    held = chosen.join(nodes.select(doc, "node_id", F.col(text).alias("_t")), [doc, "node_id"])
    return held.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "_t"))), lambda x: x["_t"]), "\n\n").alias("context"))


def pages_of(nodes: DataFrame, chosen: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, rank, page_no: the pages of the chosen nodes, each where it is first met."""
    spread = chosen.join(nodes.select(doc, "node_id", "start_index", "end_index"), [doc, "node_id"]).filter("start_index <= end_index").select(doc, "place", F.explode(F.sequence("start_index", "end_index")).alias("page_no"))
    first = spread.groupBy(doc, "page_no").agg(F.min("place").alias("place"))
    return first.select(doc, F.row_number().over(Window.partitionBy(doc).orderBy("place", "page_no")).alias("rank"), "page_no")


def fenced_pages(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with page and content of each entry of the JSON array between the first and last fence."""
    body = F.regexp_extract(F.col(reply), r"(?s)```(?:json)?\s*(.*)```", 1)
    return replies.select("*", F.inline(F.from_json(body, "array<struct<page:int,content:string>>")))


def answered(contexts: DataFrame, query: str, client: Client) -> DataFrame:
    """contexts (context) with answer."""
    return called(contexts, prompt_of("answer", query=F.lit(query), text=F.col("context")), client).withColumnRenamed("reply", "answer").drop("status")


def search_description(docs: DataFrame, query: str, client: Client, block: int = 500) -> DataFrame:
    """doc_id that the model names from (doc_id, doc_name, doc_description), asked in blocks of documents."""
    line = F.concat_ws(" | ", F.col("doc_id").cast("string"), "doc_name", "doc_description")
    lists = docs.withColumn("_b", F.expr(f"doc_id DIV {block}")).groupBy("_b").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("_list"))
    told = called(lists, prompt_of("documents", query=F.lit(query), text=F.col("_list")), client, True)
    ids = F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), "struct<answer:array<long>>")["answer"]
    return told.select(F.explode(ids).alias("doc_id")).join(docs.select("doc_id"), "doc_id", "left_semi").distinct()
