"""Word tables that become sections: the gate, breadcrumbs and section texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.tables import normalize_rows, plain_table
from folioscope.operators.enrich import Client, called, prompt_of

#: The words before a breadcrumb, and the least rows and columns of a table that can become sections.
CRUMB, LEAST_ROWS, LEAST_COLUMNS, SHOWN_ROWS = "路径", 2, 2, 5


def row_text(headers: Column, row: Column, crumbs: Column, name: Column) -> Column:
    """The breadcrumb and a "header: value" line for each value that is not empty."""
    pairs = F.filter(F.arrays_zip(headers.alias("h"), row.alias("v")), lambda z: F.coalesce(z["v"], F.lit("")) != "")
    lines = F.transform(pairs, lambda z: F.concat(z["h"], F.lit(": "), z["v"]))
    head = F.concat(F.lit(f"{CRUMB}: "), F.array_join(F.concat(crumbs, F.array(name)), " > "))
    return F.array_join(F.concat(F.array(head), lines), "\n")


def expanded_tables(tables: DataFrame, client: Client) -> DataFrame:
    """doc_id, item_no, row_no, kind, level, text of tables (doc_id, item_no, cells, crumbs, level) that the model expands.

    Only tables of enough rows and columns are asked about; rows without a name are left out, others give a heading one
    level below the table's and a text. Tables that are not expanded are one text of plain rows.
    """
    held = tables.withColumn("_rows", normalize_rows(F.col("cells")))
    fit = (F.size("_rows") > LEAST_ROWS) & (F.size(F.try_element_at("_rows", F.lit(1))) >= LEAST_COLUMNS)
    shown = plain_table(F.slice("_rows", 1, SHOWN_ROWS + 1))
    told = called(held, F.when(fit, prompt_of("expand_table", text=shown)), client, True)
    reply = F.regexp_extract(F.coalesce("reply", F.lit("")), r"(?s)(\{.*\})", 1)
    at = F.coalesce(F.get_json_object(reply, "$.name_column_index").try_cast("int"), F.lit(0))
    told = told.withColumns({"_go": F.coalesce(F.get_json_object(reply, "$.expand") == "true", F.lit(False)), "_at": F.when((at >= 0) & (at < F.size(F.try_element_at("_rows", F.lit(1)))), at).otherwise(0)})
    rows = told.filter("_go").select("doc_id", "item_no", "crumbs", "level", "_at", F.element_at("_rows", 1).alias("h"), F.posexplode(F.slice("_rows", F.lit(2), F.size("_rows"))).alias("row_no", "r"))
    named = rows.withColumn("name", F.element_at("r", F.col("_at") + 1)).filter("name <> ''")
    parts = F.array(F.struct(F.lit("heading").alias("kind"), (F.col("level") + 1).alias("level"), F.col("name").alias("text")), F.struct(F.lit("text").alias("kind"), F.lit(None).cast("int").alias("level"), row_text(F.col("h"), F.col("r"), F.col("crumbs"), F.col("name")).alias("text")))
    out = named.select("doc_id", "item_no", "row_no", F.inline(parts))
    plain = told.filter("NOT _go").select("doc_id", "item_no", F.lit(0).alias("row_no"), F.lit("text").alias("kind"), F.lit(None).cast("int").alias("level"), plain_table(F.col("_rows")).alias("text"))
    return out.unionByName(plain)
