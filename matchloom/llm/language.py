"""Language ID: interpolated Kneser-Ney character models, one per language, in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, trim_worker

ORDER = 4
SPACE = 32
#: Bounds of the training sample of a language, in characters and documents, on average.
MAX_CHARS = 1_500_000
MAX_DOCS = 20_000
#: A fifth of the sample calibrates scores and rejection; the rest is counted.
CALIBRATION = 5
BETAS = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
MOST_CHARS = 300
NONE = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


# ---- characters


def letters_of(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    kinds, at = np.unique(codes, return_inverse=True)
    return np.array([chr(c).isalpha() for c in kinds], dtype=bool)[at] if len(kinds) else np.zeros(0, bool)


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, where each begins, and its number of scored characters (0 without a letter).

    Texts are lower-cased, runs of anything but letters become one space, and each text begins with three spaces.
    """
    coded = [np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    codes = np.concatenate(coded) if coded else np.zeros(0, np.uint32)
    letter = letters_of(codes)
    first = np.cumsum(sizes) - sizes
    keep = letter | np.append(False, letter[:-1])
    kept = np.add.reduceat(keep, first) if len(first) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), kept)
    out = np.full(len(owner) + (ORDER - 1) * len(texts), SPACE, np.uint32)
    out[np.arange(len(owner)) + (ORDER - 1) * (owner + 1)] = np.where(letter[keep], codes[keep], SPACE)
    whole = kept + ORDER - 1
    return out, np.cumsum(whole) - whole, kept


def hashes(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of rows of code points; the number of columns takes part."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h


def gram_columns(codes: np.ndarray) -> list[np.ndarray]:
    n = len(codes) - ORDER + 1
    return [codes[i:i + n] for i in range(ORDER)]


def scored_places(first: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Where the windows begin that end at a scored character."""
    return np.repeat(first - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())


def distinct(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each place the number of its window, and the distinct windows' characters."""
    columns = [c[places] for c in gram_columns(codes)] if len(places) else [np.zeros(0, np.uint32)] * ORDER
    number, values = pd.factorize(hashes(columns))
    where = np.empty(len(values), np.int64)
    where[number[::-1]] = np.arange(len(number))[::-1]
    return number, [c[where] for c in columns]


# ---- models


@dataclass
class Model:
    """``grams[k]`` and ``backs[k]``: sorted hashes with probabilities of k-grams and back-off weights of contexts."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    backs: list[tuple[np.ndarray, np.ndarray]]
    floor: float


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing) -> np.ndarray:
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], missing)


def fit(counts: pd.DataFrame) -> Model:
    """Interpolated Kneser-Ney from rows (c0..c3, n) of one language; lower orders count distinct left neighbours."""
    names = [f"c{i}" for i in range(ORDER)]
    tables = [counts[[*names, "n"]]]
    for k in range(1, ORDER):
        tables.append(tables[-1].groupby(names[k:], as_index=False).agg(n=("n", "size")))
    vocabulary, grams, backs, below, floor = len(tables[-1]) + 1, [], [], None, 0.0
    for k in range(ORDER - 1, -1, -1):
        table, own = tables[k], names[k:]
        once, twice = (table["n"] == 1).sum(), (table["n"] == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        if len(own) == 1:
            total, kinds = table["n"].sum(), len(table)
            floor = discount * kinds / total / vocabulary
            p = (table["n"] - discount) / total + floor
            backs.append((np.zeros(1, np.uint64), np.zeros(1)))
        else:
            context = table.groupby(own[:-1])["n"]
            total, kinds = context.transform("sum"), context.transform("size")
            lower = _find(below, hashes([table[c].to_numpy() for c in own[1:]]), floor)
            p = (table["n"] - discount) / total + discount * kinds / total * lower
            weights = table.groupby(own[:-1], as_index=False)["n"].agg(["sum", "size"]).reset_index()
            backs.append(_sorted(hashes([weights[c].to_numpy() for c in own[:-1]]), (discount * weights["size"] / weights["sum"]).to_numpy()))
        below = _sorted(hashes([table[c].to_numpy() for c in own]), p.to_numpy())
        grams.append(below)
    return Model(grams, backs, float(floor))


def surprise(model: Model, columns: list[np.ndarray]) -> np.ndarray:
    """Negative log probability of the last character of each window given those before it."""
    p = np.full(len(columns[0]), model.floor)
    for k in range(1, ORDER + 1):
        own = columns[ORDER - k:]
        backed = p if k == 1 else p * _find(model.backs[k - 1], hashes(own[:-1]), 1.0)
        p = _find(model.grams[k - 1], hashes(own), backed)
    return -np.log(np.maximum(p, 1e-300))


@dataclass
class Identifier:
    languages: list[str]
    models: list[Model]
    beta: float = 0.1
    typical: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = float("inf")

    def parts(self) -> tuple:
        """Plain lists, arrays and numbers, which a broadcast carries to workers that have no copy of this package."""
        return [(m.grams, m.backs, m.floor) for m in self.models], self.languages, self.beta, self.typical, self.spread, self.limit

    @classmethod
    def of(cls, parts: tuple) -> Identifier:
        models, languages, *rest = parts
        return cls(languages, [Model(*m) for m in models], *rest)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and the texts' numbers of characters."""
        codes, first, kept = stream(texts)
        scored = kept
        places = scored_places(first, scored)
        number, columns = distinct(codes, places)
        out = np.zeros((len(texts), len(self.models)))
        some = np.flatnonzero(scored)
        if len(some):
            cuts = (np.cumsum(scored) - scored)[some]
            for j, model in enumerate(self.models):
                out[some, j] = np.add.reduceat(surprise(model, columns)[number], cuts) / scored[some]
        return out, scored

    def posterior(self, entropies: np.ndarray, n: np.ndarray) -> np.ndarray:
        weight = -self.beta * np.minimum(n, MOST_CHARS)[:, None] * entropies
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        return weight / weight.sum(axis=1, keepdims=True)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected, for each text."""
        if not self.models:
            return [NONE] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropies, n = self.entropies(texts)
        best, rows = entropies.argmin(axis=1), np.arange(len(texts))
        score = np.where(n > 0, self.posterior(entropies, n)[rows, best], 0.0)
        odd = n == 0
        if self.typical is not None:
            odd = odd | (self.excess(entropies[rows, best], best, n) > self.limit)
        return [self.languages[b] if k else NONE for b, k in zip(best, n)], score, odd

    def excess(self, entropy: np.ndarray, language: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far the entropy lies above the language's own, in spreads of a text of that length."""
        return (entropy - self.typical[language]) * np.sqrt(np.minimum(n, MOST_CHARS)) / self.spread[language]


# ---- training


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        frame = batch.to_pandas()
        for lang, texts in frame.groupby("lang")["text"]:
            codes, first, kept = stream(list(texts))
            number, columns = distinct(codes, scored_places(first, kept))
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(columns[0]), pa.string()),
                **{f"c{i}": pa.array(c.astype(np.int32), pa.int32()) for i, c in enumerate(columns)},
                "n": pa.array(np.bincount(number, minlength=len(columns[0])), pa.int64()),
            })


def training_sample(docs: DataFrame, max_chars: int, max_docs: int) -> DataFrame:
    """(lang, text, part) of labelled documents outside the held-out fold; about ``max_chars`` characters and at most
    about ``max_docs`` documents of a language, chosen by hash of the text. Part 0 calibrates."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id"))).select("lang", "text")
    sizes = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("docs"))
    shares = sizes.select(
        F.col("lang").alias("of"),
        F.least(F.lit(1.0), F.lit(float(max_chars)) / F.greatest("chars", F.lit(1)), F.lit(float(max_docs)) / F.col("docs")).alias("share"),
    )
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    # One row per language.
    return labelled.join(F.broadcast(shares), F.col("lang") == F.col("of")).filter(place < F.col("share") * 1_000_000).select(
        "lang", "text", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(CALIBRATION)).alias("part")
    )


def train(docs: DataFrame, max_chars: int = MAX_CHARS, max_docs: int = MAX_DOCS) -> Identifier:
    """Fit models on a bounded sample of labelled documents (doc_id, text, lang); one language's model has at most as
    many entries as its sample has characters, times the order."""
    sample = training_sample(docs, max_chars, max_docs)
    kinds = ", ".join(f"c{i} int" for i in range(ORDER))
    counted = sample.filter("part > 0").select("lang", "text").mapInArrow(_count, f"lang string, {kinds}, n long")
    counts = counted.groupBy("lang", *(f"c{i}" for i in range(ORDER))).agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return Identifier([], [])
    languages = sorted(counts["lang"].unique())
    by = dict(list(counts.groupby("lang")))
    known = Identifier(languages, [fit(by[lang]) for lang in languages])
    shared = docs.sparkSession.sparkContext.broadcast(known.parts())

    def measure(batches):
        judge = Identifier.of(shared.value)
        for batch in batches:
            frame = batch.to_pandas()
            for low in range(0, len(frame), 128):
                part = frame.iloc[low:low + 128]
                entropies, n = judge.entropies(list(part["text"]))
                yield pa.RecordBatch.from_pydict({"lang": pa.array(part["lang"], pa.string()), "h": pa.array(list(entropies), pa.list_(pa.float64())), "n": pa.array(n, pa.int64())})

    trial = sample.filter("part = 0").select("lang", "text").mapInArrow(measure, "lang string, h array<double>, n long").filter("n > 0").toPandas()
    trial = trial[trial["lang"].isin(languages)]
    if trial.empty:
        return known
    entropies, n = np.array(trial["h"].tolist()), trial["n"].to_numpy()
    right = trial["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    rows = np.arange(len(right))

    def loss(beta):
        known.beta = beta
        return -np.log(np.maximum(known.posterior(entropies, n)[rows, right], 1e-12)).mean()

    known.beta = min(BETAS, key=loss)
    own = entropies[rows, right]
    known.typical = np.array([np.average(own[right == j], weights=n[right == j]) if (right == j).any() else own.mean() for j in range(len(languages))])
    scaled = (own - known.typical[right]) * np.sqrt(np.minimum(n, MOST_CHARS))
    known.spread = np.array([max(scaled[right == j].std(), 1e-6) if (right == j).any() else max(scaled.std(), 1e-6) for j in range(len(languages))])
    # Nothing like the labelled texts is rejected: the limit lies half above the oddest of them.
    known.limit = 1.5 * max(4.0, float(known.excess(own, right, n).max()))
    return known


# ---- use


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", known: Identifier | None = None) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score, rejected``.

    ``lang_pred`` is the language of the lowest cross-entropy per character (ties: first by code point), ``score``
    its calibrated share among the languages. Null texts and texts without a letter are ``und`` with score 0, and so
    is everything if there is nothing to learn from. Rejected are these and texts far stranger to their language than
    any calibration text. A null id counts as the empty text for the fold. Rows that repeat get equal results; whole
    texts are scored, however long. No rows give no rows.
    """
    rows = plain(docs, id_col, text_col, lang_col).select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")
    )
    shared = docs.sparkSession.sparkContext.broadcast((known or train(rows)).parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Identifier.of(shared.value)
        for batch in batches:
            for texts, part in _slices(batch, 1):
                said, score, odd = judge.judge(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(odd, pa.bool_())],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    chosen = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, known: Identifier | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``identify`` does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((known or train(plain(docs, "doc_id", "text", "lang"))).parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Identifier.of(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for texts, part in _slices(batch, at):
                yield part.filter(pa.array(~judge.judge(texts)[2]))

    return docs.mapInArrow(run, docs.schema)


def _slices(batch: pa.RecordBatch, at: int, most: int = 500_000) -> Iterator[tuple[list[str | None], pa.RecordBatch]]:
    """Cuts of a batch with about ``most`` characters each."""
    texts, low, size = batch.column(at).to_pylist(), 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most or i == len(texts) - 1:
            yield texts[low:i + 1], batch.slice(low, i + 1 - low)
            low, size = i + 1, 0
    trim_worker()
