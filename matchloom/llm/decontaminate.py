"""Benchmark decontamination: approximate passages by pigeonhole pieces and Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain

ERROR = 0.05
#: Items shorter than this (normalised) are matched with whole documents only.
MIN_CHARS = 20
#: Characters of items that one automaton holds; a larger benchmark is searched in several blocks.
BLOCK_CHARS = 1_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(n: int, error: float) -> int:
    return int(n * error)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, text) of errors + 1 pieces; an occurrence with so many errors holds one of them unchanged."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text`` and where the first such substring ends.

    Bit i of the vertical vectors says whether the distance rises or falls from pattern row i to i + 1.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    rise, fall, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | fall
        horizontal = (((eq & rise) + rise) ^ rise) | eq
        up = fall | ~(horizontal | rise) & full
        down = rise & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        rise = (down | ~(vertical | up)) & full
        fall = up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Finder:
    """Exact piece hits of a block of items in a text, verified; built once per task."""

    def __init__(self, items: list[tuple[int, str]], error: float, min_chars: int):
        import ahocorasick

        self.items, self.masks, self.whole = {}, {}, {}
        self.machine, places = ahocorasick.Automaton(), {}
        for k, (item_id, text) in enumerate(items):
            if len(text) < min_chars:
                if text:
                    self.whole.setdefault(text, []).append(item_id)
                continue
            errors = budget(len(text), error)
            self.items[k] = (item_id, text, errors)
            for offset, piece in pieces(text, errors):
                places.setdefault(piece, []).append((k, offset, len(piece)))
        for piece, owners in places.items():
            self.machine.add_word(piece, owners)
        if places:
            self.machine.make_automaton()
        self.any = bool(places)

    def find(self, raw: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) for the items found, at their least distance; ``end`` counts normalised characters."""
        text = normal(raw)
        out, tried, found = [(i, 0, len(text)) for i in self.whole.get(text, ())], set(), {}
        for last, owners in self.machine.iter(text) if self.any else ():
            for k, offset, size in owners:
                at = last + 1 - size - offset
                if (k, at) in tried or found.get(k, (1, 0))[0] == 0:
                    continue
                tried.add((k, at))
                _, item, errors = self.items[k]
                if at >= 0 and text.startswith(item, at):
                    found[k] = (0, at + len(item))
                    continue
                if k not in self.masks:
                    self.masks[k] = letter_masks(item)
                low = max(0, at - errors)
                distance, end = myers(self.masks[k], len(item), text[low:at + len(item) + errors])
                if distance <= errors and distance < found.get(k, (errors + 1, 0))[0]:
                    found[k] = (distance, low + end)
        return out + [(self.items[k][0], d, e) for k, (d, e) in found.items()]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, normalised, in blocks of about ``block_chars`` characters that fit a broadcast."""
    rows = plain(benchmark, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.filter("text IS NOT NULL AND item_id IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], normal(r["text"])) for r in part.collect()]


def _search(items, error: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items.value, error, min_chars)
        for batch in batches:
            rows = [(key, *hit) for key, text in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in finder.find(text.as_py())]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())],
                names=["doc_id", "item_id", "distance", "end_char"],
            )

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", error: float = ERROR, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, distance, end_char) for each document and each benchmark item that occurs in it.

    Texts are compared in lower case with white space folded. An item of n characters occurs where some substring of
    the document is within floor(n * error) edits of it; the least distance is given. Shorter items than
    ``min_chars`` must equal the document. Null and empty texts and items match nothing; items without an id are
    left out. Rows that repeat an id or an item are matched each. Documents are scanned whole, once per block of
    items; nothing is shuffled.
    """
    rows = plain(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL")
    schema, out = "doc_id long, item_id long, distance int, end_char long", None
    for items in item_blocks(benchmark, item_id_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        hits = rows.mapInArrow(_search(shared, error, min_chars), schema)
        out = hits if out is None else out.unionAll(hits)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", error: float = ERROR, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns; null texts stay."""
    kept = docs
    for items in item_blocks(benchmark, "item_id", "text", block_chars):
        kept = kept.mapInArrow(_without(docs.sparkSession.sparkContext.broadcast(items), text_col, error, min_chars), docs.schema)
    return kept


def _without(items, text_col: str, error: float, min_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items.value, error, min_chars)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            stay = np.array([not t.is_valid or not finder.find(t.as_py()) for t in texts], dtype=bool)
            yield batch.filter(pa.array(stay))

    return run
