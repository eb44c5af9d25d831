"""Line dedup: repeated windows of consecutive lines, found over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.plans.durable import spool

from .common import plain, spool_small, whole_text


def line_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(row, doc_id, pos, digest) for each run of ``width`` consecutive lines; a digest is the MD5 of the joined lines."""
    lines = docs.select("row", "doc_id", F.split(whole_text(), "\n", -1).alias("lines"))
    starts = F.when(F.size("lines") >= width, F.sequence(F.lit(0), F.size("lines") - width))
    digests = F.transform(starts, lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, width), "\n").cast("binary"))))
    return lines.select("row", "doc_id", F.posexplode(digests).alias("pos", "digest"))


def repeated_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """(row, covered): the sorted line numbers to remove, for rows that lose lines.

    The first occurrence of a window by (doc_id, row, line number) stays; each later one covers its ``width`` lines, and
    overlapping covers merge. Occurrences of a window combine on the map side before they are shuffled.
    """
    windows = line_windows(docs, width)
    place = F.struct("doc_id", "row", "pos")
    firsts = windows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(spool(firsts, "line-windows"), "digest").filter(place > F.col("first"))
    covered = later.select("row", F.explode(F.sequence("pos", F.col("pos") + width - 1)).alias("line"))
    return covered.groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("covered"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per input row: ``doc_id, text`` (kept lines), ``n_lines, n_removed``.

    Lines end at a line feed; they are compared as they are. Null text is the empty text, which has one empty line.
    Texts of fewer than ``width`` lines have no window and stay whole. Windows of empty lines count like others. A
    null id sorts before all ids. Rows that repeat an id or have none are documents of their own, in the order of a
    hash of their text; each loses its own lines only, and equal rows lose them but for one. No rows give no rows.
    """
    rows = plain(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(f"`{text_col}`").alias("text"))
    # Rows are told apart by a number that is written once; the hash before it makes reruns agree.
    rows = spool_small(rows.withColumn("row", F.struct(F.xxhash64("text").alias("look"), F.monotonically_increasing_id().alias("number"))), "numbered-lines")
    gone = repeated_lines(rows, width)
    joined = rows.join(gone, "row", "left").withColumn("lines", F.split("text", "\n", -1))
    none, n = F.array().cast("array<int>"), F.size("lines")
    inside = F.coalesce("covered", none)
    # Kept lines are the gaps between covered positions.
    gaps = F.zip_with(
        F.concat(F.array(F.lit(-1)), inside), F.concat(inside, F.array(n)),
        lambda a, b: F.struct((a + 2).alias("start"), (b - a - 1).alias("length")),
    )
    kept = F.flatten(F.transform(F.filter(gaps, lambda g: g["length"] > 0), lambda g: F.slice("lines", g["start"], g["length"])))
    return joined.select("doc_id", F.array_join(kept, "\n").alias("text"), n.alias("n_lines"), F.size(inside).alias("n_removed"))


def digest_rows(deduped: DataFrame) -> DataFrame:
    return deduped.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
windows AS (
  SELECT doc_id, unnest(range(len(lines) - 2)) AS pos,
         unnest(list_transform(range(len(lines) - 2), lambda i: array_to_string(lines[i + 1:i + 3], chr(10)))) AS content
  FROM split WHERE len(lines) >= 3),
later AS (SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) > 1),
covered AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM later)
SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id
"""
