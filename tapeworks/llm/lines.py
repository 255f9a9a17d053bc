"""Line dedup: lines that many documents share stay only in the last document that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import BLANKS, as_id, ascii_lower, id_or_none, keep, whole_text

SALTS = 8


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: document, tag of its text, position and 128 bits of the key's hash."""
    rows = docs.select(id_or_none().alias("_id"), whole_text().alias("_text"))
    lines = rows.select("_id", F.xxhash64("_text").alias("tag"), F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
    trimmed = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter(F.char_length("line") >= min_chars)
    key = trimmed.withColumn("line", ascii_lower(F.col("line")))
    return key.select("_id", "tag", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every document with its shared lines taken out: doc_id, n_lines, n_dropped, text.

    A text is split at line feeds; a null or empty one is one empty line. A line's key is the line without ASCII blanks
    at its ends and with A-Z lower-cased. Keys of ``min_chars`` code points or more found in ``min_docs`` documents or
    more lose their lines everywhere but in the largest doc_id that holds them. Rows that share a doc_id count as one
    document, rows without one as a document before all others; each row gets its own result. Other columns are ignored.

    Only hashes and positions are shuffled to find the lines; copies within a document and a frequent key's documents
    are reduced before the shuffle, and a frequent key meets its occurrences in ``SALTS`` parts.
    """
    keyed = keep(keyed_lines(docs, min_chars))
    frequent = (
        keyed.select("h1", "h2", "_id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("last"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("_id", "pos"), F.lit(SALTS)).cast("int"))
    drops = (
        salted.join(frequent, ["h1", "h2", "salt"]).filter(F.col("_id") != F.col("last"))
        .groupBy("_id", "tag").agg(F.collect_set("pos").alias("drops"))
    )
    rows = docs.select(id_or_none().alias("_id"), whole_text().alias("_text")).withColumn("tag", F.xxhash64("_text"))
    joined = rows.join(drops, ["_id", "tag"], "left")
    lines = F.split("_text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    kept = F.concat_ws("\n", F.transform(stay, lambda i: F.get(lines, i)))
    return joined.select(
        as_id("_id").alias("doc_id"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("_text")).otherwise(kept).alias("text"),
    )
