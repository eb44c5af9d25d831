"""Mixing sources to target weights by entropy balancing, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.plans.durable import spool

from .common import WORD, plain

TOP_RATE = 3.0


def token_targets(sources: DataFrame, cap: float = TOP_RATE) -> DataFrame:
    """Adds ``weight`` and ``target`` to rows of (skey, source_size); one row per source.

    Sources in code point order weigh 1, 2, 3, 1, ...; they share all tokens by weight. A target stops at ``cap``
    times its source's size and the excess is shared again by weight: the level at which shares settle is read off
    the sources in order of cap per weight. The windows run over one row per source.
    """
    ordered = sources.withColumn("weight", (F.row_number().over(W.orderBy("skey")) - 1) % 3 + 1)
    ordered = ordered.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    before = W.orderBy(F.col("limit") / F.col("weight"), "skey").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    ordered = ordered.withColumn("level", level.cast("double"))
    # The first source whose cap lies above the level of those before it sets the final level.
    final = F.min(F.when(F.col("limit") / F.col("weight") > F.col("level"), F.struct(F.col("limit") / F.col("weight"), "skey", "level"))).over(everything)
    return ordered.withColumn("target", F.least(F.col("limit"), F.coalesce(final["level"], F.lit(0.0)) * F.col("weight"))).select(
        "skey", "source_size", "weight", "target"
    )


def balance(groups: DataFrame, targets: DataFrame, cap: float = TOP_RATE, tolerance: float = 1e-12, rounds: int = 60) -> DataFrame:
    """Rates (skey, source_size, target, rate) with rate = exp(multiplier), from Newton steps on the convex dual.

    The mix minimises the entropy of document rates against rate one, every document weighed by its tokens, subject
    to each source's token constraint. The dual is the sum over documents of tokens * exp(multiplier of the source)
    minus target * multiplier; its gradient is gathered from ``groups`` (skey, size, n) in each round, its Hessian is
    diagonal as a document has one source. Steps are damped to one; the multipliers are written out between rounds.
    Sources without tokens get rate zero.
    """
    state = targets.withColumn("multiplier", F.lit(0.0))
    for _ in range(rounds):
        tilted = (
            groups.join(state.select("skey", "multiplier"), "skey").groupBy("skey")
            .agg(F.sum(F.col("size") * F.col("n") * F.exp("multiplier")).alias("mass"))
        )
        gap = F.col("target") - F.col("mass")
        step = F.when(F.col("mass") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gap / F.col("mass")))).otherwise(0.0)
        state = spool(
            state.join(tilted, "skey").select(
                "skey", "source_size", "weight", "target", (F.col("multiplier") + step).alias("multiplier"),
                F.when(F.col("mass") > 0, F.abs(gap) / F.col("mass")).otherwise(0.0).alias("miss"),
            ),
            "multipliers",
        )
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst <= tolerance:
            break
    rate = F.when(F.col("source_size") > 0, F.round(F.least(F.lit(float(cap)), F.exp("multiplier")), 9)).otherwise(0.0)
    return state.select("skey", "source_size", "target", rate.alias("rate"))


def ranked(sized: DataFrame, groups: DataFrame, rank_rows: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``place``: 1, 2, ... within the source by size, MD5 of the id and id, then the columns ``ties``.

    A (source, size) group of n rows is cut into ceil(n / rank_rows) ranges of the MD5; counts of the ranges give the
    first place of each, so that a task orders about ``rank_rows`` rows, however many rows share source and size.
    """
    cut = groups.select("skey", "size", F.ceil(F.col("n") / rank_rows).alias("ranges"))
    point = F.conv(F.substring("tie", 1, 8), 16, 10).cast("long")
    rows = sized.join(cut, ["skey", "size"]).withColumn("cell", F.floor(point * F.col("ranges") / F.lit(float(2**32)))).drop("ranges")
    order = W.partitionBy("skey").orderBy("size", "cell")
    cells = rows.groupBy("skey", "size", "cell").agg(F.count(F.lit(1)).alias("m")).select(
        "skey", "size", "cell", (F.sum("m").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("m")).alias("base")
    )
    inner = W.partitionBy("skey", "size", "cell").orderBy("tie", "doc_id", *ties)
    return rows.join(cells, ["skey", "size", "cell"]).withColumn("place", F.col("base") + F.row_number().over(inner)).drop("base", "cell")


def source_key(source: Column) -> Column:
    """Never null; sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = TOP_RATE, rank_rows: int = 100_000) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, rate, copies, taken``.

    Copies are rounded systematically: documents of a source in order of size get round(rate * place) minus the same
    of the place before, so a source's taken tokens miss its target by about one document at most, and no document
    gets more than ceil(rate) copies. Places follow size, MD5 of the id and id, so reruns agree; rows that repeat id,
    source and size are interchangeable. Null text: size 0. Null source: a source of its own, last in order. Null ids
    share one MD5 key. No rows, or only empty texts: nothing is taken.
    """
    dealt = _dealt(docs, id_col, text_col, source_col, cap, rank_rows)
    return dealt.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def row_copies(
    docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = TOP_RATE, rank_rows: int = 100_000
) -> DataFrame:
    """(row, copies): what ``mix`` gives each row, by the column ``row_col``, which tells all rows apart.

    Rows that repeat id, source and size are placed by a hash of the text, then by ``row_col``.
    """
    return _dealt(docs, id_col, text_col, source_col, cap, rank_rows, row_col).select("row", "copies")


def _dealt(docs: DataFrame, id_col: str, text_col: str, source_col: str, cap: float, rank_rows: int, row_col: str | None = None) -> DataFrame:
    chosen = plain(docs, id_col, text_col, source_col, *([row_col] if row_col else []))
    ties = {"look": F.xxhash64(F.col(f"`{text_col}`")), "row": F.col(f"`{row_col}`")} if row_col else {}
    sized = chosen.select(
        F.col(f"`{id_col}`").alias("doc_id"), source_key(F.col(f"`{source_col}`").cast("string")).alias("skey"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("tie"),
        *(column.alias(name) for name, column in ties.items()),
    )
    sized = spool(sized, "sizes")
    groups = spool(sized.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")), "size-groups")
    sources = groups.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rates = balance(groups, spool(token_targets(sources, cap), "targets"), cap)
    upto = lambda place: F.floor(F.col("rate") * place + F.lit(0.5))
    placed = ranked(sized, groups, rank_rows, tuple(ties)).join(rates, "skey")
    return placed.withColumn("copies", (upto(F.col("place")) - upto(F.col("place") - 1)).cast("long"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS tie FROM documents),
sources AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight,
         CAST(sum(size) AS BIGINT) * 3.0E0 AS lim FROM sized GROUP BY skey),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(lim) OVER b, 0.0E0))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM sources WINDOW b AS (ORDER BY lim / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, (lim / weight, skey)) AS level FROM levels WHERE lim / weight > level),
targets AS (
  SELECT skey, source_size, least(lim, coalesce((SELECT level FROM final), 0.0E0) * weight) AS target,
         CASE WHEN source_size > 0 THEN round(least(3.0E0, least(lim, (SELECT level FROM final) * weight) / source_size), 9) ELSE 0.0E0 END AS rate
  FROM levels),
placed AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY size, tie, doc_id) AS place FROM sized)
SELECT doc_id, size, source_size, target, rate,
       CAST(floor(rate * place + 0.5E0) - floor(rate * (place - 1) + 0.5E0) AS BIGINT) AS copies,
       CAST(floor(rate * place + 0.5E0) - floor(rate * (place - 1) + 0.5E0) AS BIGINT) * size AS taken
FROM placed JOIN targets USING (skey)
"""
