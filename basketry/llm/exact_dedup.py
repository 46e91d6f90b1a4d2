"""Exact duplicates, with frequent digests split off.

Misra-Gries counters (Spark's own freqItems keeps them) name every digest with more than
`support` of the rows, and at most 1 / support others. What those digests' rows really
are is then summed up: their true counts and the row that stays of each. That table has
at most 1 / support rows, whatever the input, so it is broadcast and the rows of frequent
digests get their answer where they lie. All other digests have few rows each and are
grouped by an ordinary shuffle of (digest, id, length); texts are never shuffled.

Null texts count as empty. Rows with a null id take part, ordered behind other ids of the
same length. Rows that share an id and a text are members of a group each; the one that
stays is known by its id, so both show as kept, unless a column with a key of each row is
given: then one row of each group is kept, null and repeated ids included. An empty table
gives an empty result. Very long texts are hashed whole where they lie. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm._spark import saved

#: Share of all rows from which a digest counts as frequent; 1 / SUPPORT bounds the broadcast table.
SUPPORT = 0.002


def digest(text_column: str = "text") -> Column:
    """SHA-256 of a text without white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(F.col(text_column), F.lit("")), " \t\n\x0b\x0c\r", ""), 256)


def digests(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", row_column: str | None = None) -> DataFrame:
    """doc_id, n (code points of the text), text_sha256 (of the text without white space); row_key, if there is one."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    key = [F.col(row_column).alias("row_key")] if row_column else []
    return documents.select(*key, F.col(id_column).alias("doc_id"), F.length(text).cast("long").alias("n"), digest(text_column).alias("text_sha256"))


def exact_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT, row_column: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. With row_column, a unique number of each row: row_key too, and kept for one row of a group, of equal ids the one with the least key."""
    rows = saved(digests(documents, id_column, text_column, row_column), "digests")
    frequent = rows.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    key = [F.col("row_key").alias("row")] if row_column else []
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("first"), *key)
    stays = [F.col("best.first").alias("keep_id"), *([F.col("best.row").alias("keep_row")] if row_column else [])]
    winner = (F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best"))
    winners = rows.join(F.broadcast(frequent), "text_sha256", "left_semi").groupBy("text_sha256").agg(*winner)
    winners = saved(winners.select("text_sha256", "group_size", *stays), "winners")
    hot = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(*winner).select("text_sha256", "group_size", *stays)
    cold = rest.join(groups, "text_sha256")
    out = hot.select(*cold.columns).unionByName(cold)
    if row_column:
        return out.select("row_key", "doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
