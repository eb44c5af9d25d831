"""Filter interaction audit: what each filter removes in every order, read off the lattice of applied filter sets."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import plain, spool_small, whole_text

#: Filters that a lattice takes: 8 filters have 40,320 orders and 1,024 edges.
MOST_FILTERS = 8


def edges(filters: int) -> list[tuple[int, int, int]]:
    """(state, bit, orders) of every edge of the subset lattice: ``bit`` is applied after the filters of ``state``.

    ``orders`` is the number of orders that use the edge: those reaching its state, counted forward from the empty set,
    times those leaving the state behind it, counted backward from the full set.
    """
    if not 1 <= filters <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters, not {filters}")
    bits, full = [1 << k for k in range(filters)], (1 << filters) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for bit in bits:
            if state & bit:
                reach[state] += reach[state ^ bit]
    for state in range(full, -1, -1):
        for bit in bits:
            if not state & bit:
                leave[state] += leave[state | bit]
    return [(state, bit, reach[state] * leave[state | bit]) for state in range(full + 1) for bit in bits if not state & bit]


def steps(letters: str) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, state, bit): the edges along every order of ``letters``."""
    out = []
    for order in permutations(letters):
        state = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            out.append(("".join(order), step, state, bit))
            state |= bit
    return out


def audit(failures: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from rows of (part, mask, n, good, toxic).

    ``mask`` has the bit of each filter that a document fails, the first of ``letters`` lowest; ``n``, ``good`` and ``toxic``
    count documents. Rows may repeat a part and mask. A part's masks meet every edge in place, so an edge without
    documents counts zero. Columns: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``, where ``shapley`` is the removals of the step's filter summed over all orders.
    """
    combined = failures.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    lattice = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(b).alias("bit"), F.lit(w).cast("long").alias("orders")) for s, b, w in edges(len(letters))))
    met = combined.select("*", F.explode(lattice).alias("edge")).select("part", "mask", "n", "good", "toxic", "edge.*")
    mask, state, bit = F.col("mask"), F.col("state"), F.col("bit")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(state) != 0
    count = lambda rows, what="n": F.sum(F.when(rows, F.col(what)).otherwise(0)).cast("long")
    walked = met.groupBy("part", "state", "bit", "orders").agg(
        count(mask.bitwiseAND(state.bitwiseOR(bit)) == 0).alias("kept"), count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"), count(mask == bit).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"), count(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    # A filter of a part has 2^(filters - 1) edges.
    weighed = walked.withColumn("shapley", F.sum(F.col("orders") * F.col("removed")).over(W.partitionBy("part", "bit")))
    # Fixed by the number of filters: orders times steps.
    along = failures.sparkSession.createDataFrame(steps(letters), "filter_order string, step int, state int, bit int")
    return weighed.join(F.broadcast(along), ["state", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text that is not null: few words, repeated words, capitals, marks."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * F.size(words),
        "C": F.lit(100) * capitals.cast("long") > F.lit(3) * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, mask, n, good, toxic) of documents by the filters they fail; the last bit is the repeat filter.

    Texts are read once, for a narrow written table of verdicts and SHA-256 digests. A document fails the repeat filter if
    a smaller id anywhere in the table has the same text; only digests that occur more than once are joined back, and
    Spark splits a hot one in that join.

    A null text is the empty text, a null part the empty string. A null id is larger than every id: its row repeats any
    id's equal text, while rows of null ids alone repeat nobody. Rows that repeat the smallest id and its text have no
    smaller id and do not fail. Labels that repeat an id count as good or toxic if one of them does; null ids have no label.
    """
    text = whole_text(f"`{text_col}`")
    own = text_filters(text) if filters is None else filters
    mask = sum((F.when(fails, F.lit(1 << k)).otherwise(0) for k, fails in enumerate(own.values())), F.lit(0))
    rows = spool_small(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
            mask.alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        ), "failures",
    )
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    repeats = F.coalesce(F.col("doc_id") > F.col("first"), F.col("doc_id").isNull() & F.col("first").isNotNull())
    judged = rows.join(spool_small(firsts, "repeated-texts"), "digest", "left").select(
        "doc_id", "part", (F.col("mask") + F.when(repeats, F.lit(1 << len(own))).otherwise(0)).alias("mask")
    )
    known = plain(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")
    )
    return judged.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("toxic")
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E over whole texts, by language; see ``failure_counts`` for unusual rows.

    One row per language, order and step, zeros included: 600 rows for each value of ``lang``. No documents, no rows.
    """
    return audit(failure_counts(docs, labels), "ABCDE")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT coalesce(text, '') AS body, min(doc_id) AS first FROM documents GROUP BY 1),
failed AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN coalesce(first < doc_id, doc_id IS NULL AND first IS NOT NULL) THEN 16 ELSE 0 END AS mask
  FROM words JOIN firsts USING (body)),
known AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS toxic
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, mask),
orders(word, state) AS (
  SELECT '', 0 UNION ALL
  SELECT word || letter, state + bit FROM orders, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, bit) WHERE (state & bit) = 0),
taken AS (
  SELECT word AS filter_order, step, substr(word, step, 1) AS letter, 1 << (ascii(substr(word, step, 1)) - 65) AS bit,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(word, CAST(i AS INTEGER), 1)) - 65))) AS before
  FROM orders, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step) WHERE length(word) = 5),
counted AS (
  SELECT part, filter_order, step, letter,
         CAST(coalesce(sum(n) FILTER ((mask & (coalesce(before, 0) | bit)) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & coalesce(before, 0)) = 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & coalesce(before, 0)) <> 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER ((mask & bit) <> 0 AND (mask & coalesce(before, 0)) = 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER ((mask & bit) <> 0 AND (mask & coalesce(before, 0)) = 0), 0) AS BIGINT) AS toxic_lost
  FROM masks, taken GROUP BY part, filter_order, step, letter, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
