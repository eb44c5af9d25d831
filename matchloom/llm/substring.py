"""Substring dedup: the word de Bruijn graph of repeated windows, compacted around anchors by Spark joins."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, slices, spool_small

#: Words in a window (an edge of the graph) and in an anchor.
WINDOW = 13
ANCHOR = 6
#: Verified spans end at multiples of this many words of their source, which bounds the spans of one source.
GRID = 256
#: Bytes hashed at once.
CHUNK = 4_000_000
BASE, MARK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bits of a piece's hash that tell rows of one id apart.
TAG = 0x7FFFFF
SPACE = re.compile(rb"[\x20\x09-\x0d]")
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Words:
    """Words of texts as arrays: hashes of all words in a row, and where each text's words begin."""

    def __init__(self, texts: list[bytes], seed: int):
        if max(map(len, texts), default=0) <= CHUNK:
            self.hashes, starts = _hash_words(b" ".join(texts), seed)
            sizes = np.array([len(t) + 1 for t in texts], np.int64)
            self.first = np.searchsorted(starts, np.append(0, np.cumsum(sizes)))
        else:
            each = [np.concatenate(list(_word_hashes(t, seed)) or [np.zeros(0, np.uint64)]) for t in texts]
            self.hashes = np.concatenate(each)
            self.first = np.append(0, np.cumsum([len(e) for e in each]))

    def pieces(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Signed hashes of ``length`` words from word ``start`` on."""
        at = np.arange(len(self.hashes) + 1)
        sums = np.append(np.uint64(0), np.cumsum(self.hashes * _powers(BASE, len(at))[:-1], dtype=np.uint64))
        h = (sums[start + length] - sums[start]) * _powers(INVERSE, len(at))[start]
        return _mixed(h + length.astype(np.uint64) * MARK).view(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hash_words(raw: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words: sums of a number per byte value times a power of its place in the word."""
    letters = np.frombuffer(raw, np.uint8)
    outside = np.concatenate(([True], BLANK[letters], [True]))
    turns = np.flatnonzero(outside[1:] != outside[:-1])
    start, end = turns[::2], turns[1::2]
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(values[letters] * _powers(BASE, len(letters)), dtype=np.uint64))
    h = (sums[end] - sums[start]) * _powers(INVERSE, len(letters) + 1)[start]
    return _mixed(h + (end - start).astype(np.uint64) * MARK), start


def _word_hashes(raw: bytes, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a long text's words, some megabytes at a time, cut at white space."""
    low = 0
    while low < len(raw):
        gap = SPACE.search(raw, low + CHUNK)
        high = gap.start() if gap else len(raw)
        yield _hash_words(raw[low:high], seed)[0]
        low = high


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        out = out * BASE + hashes[j:n + j] if n > 0 else out
    return _mixed(out)


def window_anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The least hash of an anchor's words in each window: equal windows have equal anchors."""
    grams = gram_hashes(hashes, anchor)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for j in range(1, window - anchor + 1):
        np.minimum(least, grams[j:n + j], out=least)
    return least


def runs_of(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of windows, anchor) of each run of windows of one text with one anchor."""
    anchors = window_anchors(words.hashes, window, anchor)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = text[:len(anchors)] == text[window - 1:]
    new = np.append(True, (anchors[1:] != anchors[:-1]) | (text[1:len(anchors)] != text[:len(anchors) - 1]))[:len(anchors)]
    # Windows across two texts end a run and belong to none.
    new |= np.append(False, inside[1:] != inside[:-1])[:len(anchors)]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(anchors)))
    first, count = first[inside[first]], count[inside[first]]
    return text[first], first, count, _signed(anchors[first])


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _anchors(window: int, anchor: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, column = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
            for low, high in slices(pc.binary_length(column).to_pylist()):
                text, _, _, own = runs_of(Words(column.slice(low, high - low).to_pylist(), seed), window, anchor)
                order = np.lexsort((own, text))
                text, own = text[order], own[order]
                new = np.append(True, (text[1:] != text[:-1]) | (own[1:] != own[:-1]))[:len(own)]
                yield pa.RecordBatch.from_arrays([pa.array(own[new]), pa.array(keys[low:high][text[new]])], names=["anchor", "doc_id"])

    return run


RUNS = "array<struct<anchor: long, piece: long, start: int, windows: int>>"
RUN_TYPE = pa.list_(pa.struct([("anchor", pa.int64()), ("piece", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())]))


def _pieces(window: int, anchor: int, seed: int):
    """Per document its words' number and, if it has repeated anchors, the runs under them and the packed text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("packed", pa.binary()), ("runs", RUN_TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            column = batch.column(1).cast(pa.binary()).fill_null(b"")
            for low, high in slices(pc.binary_length(column).to_pylist()):
                texts, marks = column.slice(low, high - low).to_pylist(), batch.column(2).slice(low, high - low)
                words = Words(texts, seed)
                text, first, count, own = runs_of(words, window, anchor)
                sizes = np.diff(words.first)
                packs = marks.is_valid().to_numpy(zero_copy_only=False) & (sizes >= window)
                # An anchor that another document's marks name is repeated and among this one's marks, too.
                some = np.flatnonzero(packs[text] & np.isin(own, marks.flatten().to_numpy()))
                text, first, count = text[some], first[some], count[some]
                columns = (own[some], words.pieces(first, count + window - 1), (first - words.first[text]).astype(np.int32), count.astype(np.int32))
                runs = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, RUN_TYPE.value_type)], fields=list(RUN_TYPE.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), runs)
                packed = [pack.compress(raw) if p else None for raw, p in zip(texts, packs.tolist())]
                shas = [None if p else hashlib.sha256(b" ".join(raw.split())).hexdigest() for raw, p in zip(texts, packs.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(packed, pa.binary()), lists.cast(RUN_TYPE)], schema=schema
                )

    return run


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers start, start + 1, ... of each run, and each number's place in its run."""
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + at, at


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """Bounds of runs of a batch's rows and their unpacked texts, some megabytes at a time."""
    unpack = zstandard.ZstdDecompressor()
    sizes = [zstandard.frame_content_size(x.as_buffer()) for x in batch.column(1)]
    for low, high in slices(sizes):
        yield low, high, [unpack.decompress(x.as_buffer()) for x in batch.column(1).slice(low, high - low)]


def _edges(window: int, seed: int):
    """Window hashes of pieces, read at their source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, flat, keys = batch.column(2).offsets.to_numpy(), batch.column(2).values, batch.column(0).to_numpy()
            pieces, starts, counts = (flat.field(k).to_numpy() for k in ("piece", "start", "windows"))
            for low, high, texts in _unpacked(batch):
                words = Words(texts, seed)
                hashes, some = gram_hashes(words.hashes, window), np.arange(cuts[low], cuts[high])
                text = np.repeat(np.arange(high - low), np.diff(cuts[low:high + 1]))
                inside = starts[some] + counts[some] + window - 1 <= np.diff(words.first)[text]
                some, text = some[inside], text[inside]
                first, count = words.first[text] + starts[some], counts[some].astype(np.int64)
                # Other places belong to another row of this id.
                own = words.pieces(first, count + window - 1) == pieces[some]
                some, text, first, count = some[own], text[own], first[own], count[own]
                if len(some):
                    pos, at = _spread(first, count)
                    yield pa.RecordBatch.from_pydict({
                        "edge": _signed(hashes[pos]), "piece": np.repeat(pieces[some], count), "at": at.astype(np.int32),
                        "doc_id": np.repeat(keys[low + text], count), "pos": (pos - np.repeat(words.first[text], count)).astype(np.int32),
                    })

    return run


SPANS = "array<struct<pos: int, n: int, source: long, source_pos: int, digest: binary>>"


def _cut(window: int, seed: int, with_text: bool):
    """Removes the words under windows that start in an earlier document and lists the spans with their sources."""
    span = pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("source_pos", pa.int32()), ("digest", pa.binary())])

    def places(covers: pa.StructArray, text: np.ndarray, words: Words, keys: np.ndarray):
        """(pos, source, source_pos) of the windows that start earlier elsewhere, by position among the words of all texts.

        ``text`` is the place of each cover's text, ``keys`` the texts' ids.
        """
        get = lambda k, x=covers: x.field(k).fill_null(0).to_numpy().astype(np.int64)
        starts, counts, tags = get("start"), get("windows"), get("tag")
        own = starts + counts + window - 1 <= np.diff(words.first)[text]
        starts = starts + words.first[text]
        # Others are of another row of this id.
        own[own] = words.pieces(starts[own], counts[own] + window - 1) & TAG == tags[own]
        edges = covers.field("edges")
        whole = own & edges.is_null().to_numpy(zero_copy_only=False)
        pos, at = _spread(starts[whole], counts[whole])
        again = lambda x, n=counts[whole]: np.repeat(x[whole], n)
        found = [(pos, again(get("source")), again(get("source_pos")) + at, again(text))]
        sizes = edges.value_lengths().fill_null(0).to_numpy()
        each, base, good, text = edges.flatten(), np.repeat(starts, sizes), np.repeat(own, sizes), np.repeat(text, sizes)
        if len(each):
            many = each.field("ats").value_lengths().to_numpy()
            ats = each.field("ats").flatten().to_numpy().astype(np.int64)
            source, shift, base, good, text = (np.repeat(x, many) for x in (get("source", each), get("shift", each), base, good, text))
            found.append(((base + ats)[good], source[good], (ats + shift)[good], text[good]))
        pos, source, source_pos, text = (np.concatenate(x) for x in zip(*found))
        earlier = source < keys[text]
        pos, first = np.unique(pos[earlier], return_index=True)
        return pos, source[earlier][first], source_pos[earlier][first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, covers, keys = batch.column(2).offsets.to_numpy(), batch.column(2).values, batch.column(0).to_numpy()
            for low, high, texts in _unpacked(batch):
                words = Words(texts, seed)
                text = np.repeat(np.arange(high - low), np.diff(cuts[low:high + 1]))
                pos, source, source_pos = places(covers.slice(cuts[low], cuts[high] - cuts[low]), text, words, keys[low:high])
                # Positions are distinct, and a text's windows end within it.
                gone = np.zeros(len(words.hashes) + 1, np.int64)
                gone[pos] += 1
                gone[pos + window] -= 1
                stays = np.cumsum(gone[:-1]) == 0
                removed = np.diff(np.append(0, np.cumsum(~stays))[words.first])
                # Windows that follow each other both here and at the source make one span.
                on = (np.diff(pos) == 1) & (np.diff(source) == 0) & (np.diff(source_pos) == 1) & (source_pos[1:] % GRID != 0)
                owner = np.searchsorted(words.first, pos, "right") - 1
                first = np.flatnonzero(np.append(True, ~on | (np.diff(owner) != 0))) if len(pos) else np.zeros(0, np.int64)
                n, owner = np.diff(np.append(first, len(pos))), owner[first]
                start = pos[first] - words.first[owner]
                cut = np.searchsorted(owner, np.arange(high - low + 1))
                digests, shas, kept = [], [], []
                for i, raw in enumerate(texts):
                    own = raw.split()
                    digests += [
                        hashlib.sha256(b" ".join(own[p:p + m + window - 1])).digest()[:16]
                        for p, m in zip(start[cut[i]:cut[i + 1]].tolist(), n[cut[i]:cut[i + 1]].tolist())
                    ]
                    left = b" ".join(compress(own, stays[words.first[i]:words.first[i + 1]].tolist()) if removed[i] else own)
                    shas.append(hashlib.sha256(left).hexdigest())
                    kept.append(left if with_text else None)
                columns = (start, n, source[first], source_pos[first], digests)
                spans = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, span)], fields=list(span))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low), pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()),
                        pa.array(kept, pa.binary()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans).cast(pa.list_(span)),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"],
                )

    return run


def _differing(window: int):
    """Source spans whose words are not those of their copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            wrong = []
            for key, texts, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows = [unpack.decompress(t).split() for t in texts]
                for s in spans:
                    if not any(hashlib.sha256(b" ".join(w[s["source_pos"]:s["source_pos"] + s["n"] + window - 1])).digest()[:16] == s["digest"] for w in rows):
                        wrong.append(key)
            yield pa.RecordBatch.from_pydict({"source": pa.array(wrong, pa.int64())})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept`` (bytes; null where nothing was removed).

    A word is removed if a window of ``window`` words covers it that also starts in a document with a smaller id.
    Windows are the edges of a de Bruijn graph. Edges with one anchor (the least hash of ``anchor`` words inside) that
    follow each other make a piece, a nonbranching path; pieces of unrepeated anchors cannot be repeated and end
    there. Equal pieces combine by join; only where an anchor has several pieces, that is where paths branch, are the
    edges themselves compared, once per distinct piece and at its source. Pieces that go on at their source join to
    spans, and each span's words are compared with those at the source's coordinates; should they differ (a hash
    collision), all is done again with other hashes.

    Null texts have no words. Texts of fewer words than a window stay whole. Rows of a null id take no part and stay
    whole. Rows that repeat id and text do not remove each other's words. No rows give no rows.
    """
    rows = plain(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    seed = 0
    while True:
        out, agrees = _attempt(rows, window, anchor, seed, with_text)
        if agrees:
            return out if with_text else out.drop("kept")
        seed += 2


def _attempt(rows: DataFrame, window: int, anchor: int, seed: int, with_text: bool) -> tuple[DataFrame, bool]:
    named = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = named.select("doc_id", "text").mapInArrow(_anchors(window, anchor, seed), "anchor long, doc_id long")
    repeated = spool_small(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "anchors")
    marks = anchors.join(repeated, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list("anchor").alias("marks"))
    pieced = rows.join(marks, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(
        _pieces(window, anchor, seed), f"doc_id long, n_words long, kept_sha256 string, packed binary, runs {RUNS}"
    )
    pieced = spool_small(pieced, "pieces")
    texts = pieced.filter("packed IS NOT NULL").select("doc_id", "packed")
    found = pieced.select("doc_id", F.explode("runs").alias("run")).select("doc_id", "run.*")
    pieces = spool_small(
        found.groupBy("anchor", "piece").agg(
            F.min("doc_id").alias("source"), F.min_by("start", "doc_id").alias("source_pos"), F.max("doc_id").alias("latest"), F.max("windows").alias("windows")
        ),
        "piece-sources",
    )
    anchored = spool_small(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("source").alias("a"), F.max("latest").alias("b")).filter("a < b").select("anchor", "kinds"), "anchor-kinds")
    live = pieces.join(anchored, "anchor")
    traces = "array<struct<source: long, shift: int, ats: array<int>>>"
    whole = live.filter("kinds = 1").select("piece", "source", "source_pos", F.lit(None).cast(traces).alias("edges"))
    wanted = live.filter("kinds > 1").groupBy(F.col("source").alias("doc_id")).agg(
        F.collect_list(F.struct("piece", F.col("source_pos").alias("start"), "windows")).alias("wanted")
    )
    edges = spool_small(
        texts.join(wanted, "doc_id").select("doc_id", "packed", "wanted").mapInArrow(_edges(window, seed), "edge long, piece long, at int, doc_id long, pos int"),
        "edges",
    )
    first = edges.groupBy("edge").agg(F.min("doc_id").alias("source"), F.min_by("pos", "doc_id").alias("first_pos"))
    # Windows of a piece that follow each other at one source are one trace.
    traced = edges.select("edge", "piece", "at").join(spool_small(first, "edge-sources"), "edge").groupBy("piece", "source", (F.col("first_pos") - F.col("at")).alias("shift")).agg(
        F.collect_list("at").alias("ats")
    )
    branching = traced.groupBy("piece").agg(F.collect_list(F.struct("source", "shift", "ats")).alias("edges")).select(
        "piece", F.lit(None).cast("long").alias("source"), F.lit(None).cast("int").alias("source_pos"), F.col("edges").cast(traces).alias("edges")
    )
    known = spool_small(whole.unionByName(branching), "sourced-pieces")
    earlier = F.when(F.col("edges").isNull(), F.col("source") < F.col("doc_id")).otherwise(F.exists("edges", lambda e: e["source"] < F.col("doc_id")))
    covers = found.drop("anchor").join(known, "piece").filter(earlier).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "windows", F.col("piece").bitwiseAND(F.lit(TAG)).cast("int").alias("tag"), "source", "source_pos", "edges")).alias("covers")
    )
    cut = spool_small(
        texts.join(covers, "doc_id", "left").select("doc_id", "packed", "covers").mapInArrow(
            _cut(window, seed, with_text), f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary, spans {SPANS}"
        ),
        "cut",
    )
    spans = cut.select(F.explode("spans").alias("s")).select("s.source", "s.source_pos", "s.n", "s.digest").distinct()
    asked = spans.groupBy("source").agg(F.collect_list(F.struct("source_pos", "n", "digest")).alias("spans"))
    sources = texts.withColumnRenamed("doc_id", "source").join(asked.select("source"), "source", "left_semi").groupBy("source").agg(F.collect_set("packed").alias("texts"))
    differing = sources.join(asked, "source").select("source", "texts", "spans").mapInArrow(_differing(window), "source long")
    agrees = differing.isEmpty()
    rest = pieced.filter("packed IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    return rest.unionByName(cut.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")), agrees


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(len(w) - 12)) AS pos,
         unnest(list_transform(range(len(w) - 12), lambda i: md5(array_to_string(w[i + 1:i + 13], ' ')))) AS content
  FROM words WHERE len(w) >= 13),
later AS (SELECT doc_id, pos FROM windows QUALIFY min(doc_id) OVER (PARTITION BY content) < doc_id),
covered AS (SELECT DISTINCT doc_id, pos + unnest(range(13)) AS pos FROM later),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM words),
kept AS (
  SELECT e.doc_id, count(*) AS n_words, count(c.pos) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY e.pos) FILTER (c.pos IS NULL), '')) AS kept_sha256
  FROM each e LEFT JOIN covered c ON c.doc_id = e.doc_id AND c.pos = e.pos GROUP BY e.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
