"""Line dedup by range-partitioned hashes, in DataFrame functions only.

Line hashes are range-partitioned and sorted by document and position; a window streams over them and marks the
first line of each document under a hash. A hash that a third of all documents hold would be one long run, so
the range key ends in a hash of the document, so its lines spread over as many ranges as it fills and a window holds
the lines of one document; marks are summed for each hash afterwards. The plan finds for
each document the runs of lines it keeps (a run-length bitmap), never text; texts are cut by it at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize, refuse, wrapped

_BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def long_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, row_hash, pos, h1, h2) of each line that is long enough to be dropped."""
    return (
        docs.where("doc_id is not null")
        # Apart from the explode, which would otherwise carry the whole text along with each of its lines.
        .select("doc_id", F.xxhash64("text").alias("row_hash"), _lines(F.col("text")).alias("lines"))
        .select("doc_id", "row_hash", F.posexplode("lines").alias("pos", "line"))
        # Step by step, so that each line is stripped once and only long ones are lower-cased, once.
        .select("doc_id", "row_hash", "pos", stripped(F.col("line")).alias("line"))
        .where(F.length("line") >= min_chars)
        .select("doc_id", "row_hash", "pos", ascii_lower(F.col("line")).alias("key"))
        .select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def repeated_keys(lines: DataFrame, min_docs: int = 3) -> DataFrame:
    """The keys (h1, h2, keeper) of lines that at least ``min_docs`` documents hold. The salt is no fixed number of parts, so
    a line that any number of documents hold leaves no window larger than the lines of the documents of one hash."""
    run = ["h1", "h2", "salt"]
    salted = lines.withColumn("salt", F.xxhash64("doc_id"))
    ranged = salted.repartitionByRange(*run).sortWithinPartitions(*run, F.desc("doc_id"), "pos")
    before = F.lag("doc_id").over(Window.partitionBy(*run).orderBy(F.desc("doc_id"), "pos"))
    firsts = ranged.select("h1", "h2", "doc_id", before.alias("before")).where("before is null or before <> doc_id")
    keys = firsts.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    return keys.select("h1", "h2", "keeper")


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """For each document that loses lines: doc_id, row_hash, and ``dropped``, the sorted positions. Lines are split and
    hashed once, into a table of some 30 bytes a line."""
    lines, _ = materialize(long_lines(docs, min_chars), "line-hashes")
    keys, _ = materialize(repeated_keys(lines, min_docs), "line-keys")
    lost = lines.join(keys, ["h1", "h2"]).where("doc_id <> keeper")
    return lost.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


ADDS = ("n_lines", "n_dropped", "keep_runs", "kept_text")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents hold, except in the largest doc_id that holds them.

    ``docs`` needs doc_id and text. All its columns come back, with these besides: n_lines (before dropping),
    n_dropped, keep_runs (the run-length bitmap: runs [start, end) of lines that stay) and kept_text (those lines
    joined by line feeds). Input columns of those four names are a ValueError; all others may have any names.

    A null or empty text is one empty line, which is too short to repeat. A row whose doc_id is null keeps all
    its lines and counts for none. Rows that share a doc_id are one document for the counts, and a line that repeats
    within one document counts once and goes or stays with all its copies. A very long text takes the memory of its
    lines in one task. An empty table gives no rows.
    """
    refuse(docs, ADDS)
    lost = dropped_lines(docs, min_chars, min_docs)
    rows = wrapped(docs)
    joined = rows.join(lost, (F.col("row.doc_id") == lost["doc_id"]) & (F.xxhash64("row.text") == lost["row_hash"]), "left")
    text = F.coalesce("row.text", F.lit(""))
    gone = F.coalesce("dropped", F.array().cast("array<int>"))
    zipped = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1)).alias("start"),
        F.concat(gone, F.array(F.col("n_lines"))).alias("end"),
    )
    runs = F.filter(zipped, lambda r: r["start"] < r["end"])
    # The lambda binds the split text once; a reference to the column would split it again for each run.
    shorter = F.transform(
        F.array(_lines(F.col("row.text"))),
        lambda ls: F.array_join(F.flatten(F.transform(F.col("keep_runs"), lambda r: F.slice(ls, r["start"] + 1, r["end"] - r["start"]))), "\n"),
    )
    done = (
        joined.withColumn("n_lines", F.size(_lines(F.col("row.text"))))
        .withColumn("n_dropped", F.size(gone))
        .withColumn("keep_runs", runs)
        .withColumn("kept_text", F.when(F.col("n_dropped") == 0, text).otherwise(shorter[0]))
    )
    return done.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *ADDS)


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, the SHA-256 of what is kept, and keep_runs as text: "0-3,5-9" keeps lines 0 to 2 and
    5 to 8 (from 0); empty if no line stays."""
    done = dedup_lines(docs.select(F.col("doc_id").cast("long"), "text"), min_chars, min_docs)
    shown = F.array_join(F.transform("keep_runs", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return done.select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256"), shown.alias("keep_runs"))


def line_report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """line_bitmaps without the bitmap."""
    return line_bitmaps(docs, min_chars, min_docs).drop("keep_runs")


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT d.doc_id, d.pos, d.line, o.k IS NOT NULL AND d.doc_id <> o.keeper AS gone
  FROM keyed d LEFT JOIN often o ON d.k = o.k),
runs AS (
  SELECT doc_id, string_agg(CAST(first - 1 AS VARCHAR) || '-' || CAST(last AS VARCHAR), ',' ORDER BY first) AS keep_runs
  FROM (SELECT doc_id, min(pos) AS first, max(pos) AS last
        FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM judged WHERE NOT gone)
        GROUP BY doc_id, island)
  GROUP BY doc_id)
SELECT j.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256,
       coalesce(any_value(keep_runs), '') AS keep_runs
FROM judged j LEFT JOIN runs r ON j.doc_id = r.doc_id GROUP BY j.doc_id
"""
