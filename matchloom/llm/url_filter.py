"""URL filters: rules first, then gradient-boosted trees on lexical features of the url."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.plans.durable import spool

from .common import plain

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "hyphens", "entropy", "params", "suffix_rate", "suffix_known")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and path up to ``?`` or ``#``; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits ``host`` and ``path``; block goes before allow of equal length."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        text, verdict = F.when(fits, host + path).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the lexical features that need nothing but the url, and its ``suffix`` (last label of the host)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.withColumns({
        "length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "digits": F.regexp_count(url, F.lit("[0-9]")) / n,
        "hyphens": F.regexp_count(url, F.lit("[-_]")) / n,
        "entropy": F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c)))),
        "params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
    })


def suffix_rates(known: DataFrame, least: int = 5) -> DataFrame:
    """Smoothed share of blocked urls per suffix of all labelled ones; suffixes seen fewer than ``least`` times carry none."""
    return known.groupBy("suffix").agg(
        ((F.sum("label") + 1) / (F.count(F.lit(1)) + 2)).alias("suffix_rate"), F.count(F.lit(1)).alias("seen")
    ).filter(F.col("seen") >= least).select("suffix", "suffix_rate", F.lit(1.0).alias("suffix_known"))


def url_filter(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
    labelled: DataFrame | None = None, max_train: int = 20_000, trees: int = 20, depth: int = 4, threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, score``.

    A url that a rule fits takes the rule's verdict. Others are blocked where boosted trees give ``threshold`` or
    more. The trees learn from ``labelled`` (url, verdict); without it the urls that rules decide are the labelled
    ones. The fit takes a sample of the labelled urls, chosen by hash, of ``max_train`` rows on average; it is the only
    thing sampled: the suffixes' rates count all labelled urls. ``score`` is null where a rule decides. Null urls and urls without ``://`` have empty host and
    path, match no rule and are scored like others. With labels of one class only, that class is the verdict; without
    any, ``allow``. Rows that repeat get equal verdicts. No rows give no rows.
    """
    rows = plain(pages, id_col, url_col).select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    host, path = host_and_path(F.col("url"))
    judged = rows.withColumns({"host": host, "path": path})
    rule, said = rule_of(rules)
    judged = judged.withColumns({"rule": rule, "said": said})
    if labelled is None:
        known = judged.filter("said IS NOT NULL").select("url", "host", "path", (F.col("said") == "block").cast("double").alias("label"))
    else:
        named = labelled.select("url", "verdict")
        known = named.withColumns({"host": host, "path": path}).select("url", "host", "path", (F.col("verdict") == "block").cast("double").alias("label"))
    total = known.count()
    chosen = known.filter(F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(1_000_003)) < F.lit(1_000_003 * max_train / max(total, 1)))
    train = spool(lexical(chosen).orderBy("url", "label"), "url-train")
    classes = [r[0] for r in train.select("label").distinct().collect()]
    if len(classes) < 2:
        verdict = "block" if classes == [1.0] else "allow"
        return judged.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit(verdict)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    rates = spool(suffix_rates(known.select("label", F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"))), "suffixes")
    prior = train.agg(F.avg("label")).first()[0]

    def featured(df: DataFrame) -> DataFrame:
        # One row per suffix; Spark broadcasts them by measured size only.
        return df.join(rates, "suffix", "left").fillna({"suffix_rate": prior, "suffix_known": 0.0})

    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label").fit(
        assembler.transform(featured(train)).select("features", "label")
    )
    scored = model.transform(assembler.transform(featured(lexical(judged))))
    chance = F.element_at(vector_to_array("probability"), 2)
    verdict = F.when(chance >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("said", verdict).alias("verdict"), F.when(F.col("said").isNull(), chance).alias("score")
    )

