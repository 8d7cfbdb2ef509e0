"""Line dedup: explode, hash, count documents per hash, drop lines, put texts together by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Stages

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, UPPER.lower())


#: Longer than any array: a run of lines up to the end of its text.
REST = 2**31 - 1


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): texts without lines that many documents share.

    A key of at least ``min_chars`` code points that at least ``min_docs`` documents hold loses all its
    lines except those in the largest id that holds it. Null or empty text is one empty line. Rows with
    one id count as one document for the counts and stay separate rows; equal rows fare alike. A null id
    holds no key: its lines neither count nor go. A document whose lines all go has empty text. An empty
    table gives no rows. Texts of any length are taken whole: the work is linear in a text's lines, however
    many go. Other columns are ignored.

    Lines are exploded as (document, place, two hashes); the hashes are counted, lines over the threshold
    become places to drop, and each text is put together again from the runs of lines between those
    places, by position. Texts are shuffled once, for that; a key that a third of all documents hold is
    summed before the shuffle, and the join that finds its lines can be split by Spark.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    # A row is told by its id and its text; rows equal in both have the same lines to drop.
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), F.split("text", "\n", -1).alias("lines"))
    line = docs.where("doc_id IS NOT NULL").select("doc_id", "row", F.posexplode("lines").alias("place", "line")).withColumn("key", line_key(F.col("line")))
    line = line.where(F.length("key") >= min_chars).select("doc_id", "row", "place", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    stages = Stages(docs.sparkSession, "lines")
    line = stages.put(line, "hashes")  # counted and then looked up: read twice, made once
    hot = line.groupBy("h", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h", "h2").agg(F.count("one").alias("n"), F.max("doc_id").alias("last"))
    # Written, so that both sides of the join are dealt out for it and Spark can split a key that many lines have.
    hot = stages.put(hot.where(F.col("n") >= min_docs).select("h", "h2", "last"), "shared")
    gone = line.join(hot, ["h", "h2"]).where("doc_id <> last").groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("place")).alias("gone"))
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), "gone"), F.concat("gone", F.array(F.lit(REST))), lambda a, b: F.struct((a + 2).alias("start"), (b - a - 1).alias("n")))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), runs.alias("runs"))

    # ``lines`` and ``runs`` come out of the join as values, so that no function below makes them anew for each run.
    out = docs.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left")
    kept = F.flatten(F.transform("runs", lambda r: F.slice("lines", r["start"], r["n"])))
    n = F.size("lines").cast("long")
    dropped = F.coalesce(F.size("runs") - 1, F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_lines"), dropped.alias("n_dropped"), F.array_join(F.when(F.col("runs").isNull(), F.col("lines")).otherwise(kept), "\n").alias("text"))
