"""Byte-level BPE as relations: DuckDB contracts token rows by a merge table in each task, ordered aggregation decodes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, trim_worker, whole_text

#: Characters of text whose words are encoded by one recursive query, token rows that one query decodes, and words that a
#: worker keeps. They bound memory and change no result.
SLICE_CHARS, DECODE_ROWS, MEMO_WORDS = 4_000_000, 500_000, 400_000

#: One recursion step contracts each word at its leftmost pair of least rank, until no word has a pair with a rank. ``seg`` is a
#: word or a part of one that no merge leaves, ``pos`` the place of a token's first byte; rank and place stand in one number.
ENCODE = """
WITH RECURSIVE tokens(seg, pos, id, live) AS (
  SELECT seg, pos, id, true FROM start
  UNION ALL
  SELECT * FROM (
    WITH pairs AS MATERIALIZED (
      SELECT seg, pos, id, before, CASE WHEN seg = next_seg THEN merged END AS merged
      FROM (
        SELECT seg, pos, id, lead(id) OVER line AS following, lead(seg) OVER line AS next_seg, lag(pos) OVER line AS before
        FROM tokens WHERE live WINDOW line AS (ORDER BY pos))
      LEFT JOIN merges ON id = first AND following = second),
    least AS (SELECT seg, min((merged::BIGINT << 40) | pos) AS best FROM pairs WHERE merged IS NOT NULL GROUP BY seg)
    SELECT p.seg, pos, CASE WHEN best & 1099511627775 = pos THEN (best >> 40)::INTEGER ELSE id END, best IS NOT NULL
    FROM pairs p LEFT JOIN least l ON p.seg = l.seg WHERE best IS NULL OR before IS DISTINCT FROM (best & 1099511627775)))
SELECT pos, id FROM tokens WHERE NOT live ORDER BY pos
"""

#: For words of more bytes than ``LONG_WORD``: a step contracts a word at all its pairs of least rank, from left to right, each
#: second one where they overlap. ``rivals`` lists the tokens beside which the merged token would form a pair of lower rank than
#: its own: a word's contractions end behind the first pair with a rival at hand, so the result is that of ``ENCODE``.
LONG_WORD = 64
ENCODE_LONG = """
WITH RECURSIVE tokens(seg, pos, id, live) AS (
  SELECT seg, pos, id, true FROM start
  UNION ALL
  SELECT * FROM (
    WITH pairs AS MATERIALIZED (
      SELECT seg, pos, id, place, CASE WHEN seg = next_seg THEN merged END AS merged, before, behind
      FROM (
        SELECT seg, pos, id, lead(id) OVER line AS following, lead(seg) OVER line AS next_seg, lag(id) OVER line AS before,
               lead(id, 2) OVER line AS behind, row_number() OVER line AS place
        FROM tokens WHERE live WINDOW line AS (ORDER BY pos))
      LEFT JOIN merges ON id = first AND following = second),
    least AS (SELECT seg, min(merged) AS best, min(place) AS base FROM pairs WHERE merged IS NOT NULL GROUP BY seg),
    hits AS (
      SELECT p.*, best, base, coalesce(merged = best, false) AS hit,
             merged = best AND (list_contains(tokens, before) OR list_contains(tokens, behind) OR list_contains(tokens, merged)) AS rivalled
      FROM pairs p LEFT JOIN least l ON p.seg = l.seg LEFT JOIN rivals r ON r.id = merged AND merged = best),
    runs AS (
      SELECT *, coalesce(max(CASE WHEN NOT hit THEN place END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS calm,
             coalesce(max(CASE WHEN rivalled THEN place END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS stop,
             coalesce(max(CASE WHEN rivalled THEN place END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING), 0) AS earlier
      FROM hits)
    SELECT seg, pos, CASE WHEN hit AND stop < base AND (place - calm) % 2 = 1 THEN merged ELSE id END, best IS NOT NULL
    FROM runs WHERE NOT coalesce(calm < place - 1 AND earlier < base AND (place - calm) % 2 = 0, false)))
SELECT pos, id FROM tokens WHERE NOT live ORDER BY pos
"""

#: Bytes stand in a string as the characters 256 to 511.
DECODE = "SELECT doc, string_agg(spelling, '' ORDER BY pos) AS body FROM stream JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


def ranks_of(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ranks of a rank file run from 0 without a gap")
    tokens = [ranks[k] for k in range(len(ranks))]
    if sum(len(t) == 1 for t in tokens) != 256:
        raise ValueError("a rank file has all 256 single bytes")
    return tokens


def stand_ins() -> dict[int, int]:
    """Characters that the regex package classes as letter or number and the tiktoken library does not, or the reverse.

    Their Unicode versions differ; each such character maps to one that both put where the library puts it.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    classes, out = (("\\p{L}", 0xAA), ("\\p{N}", 0xB2)), {}
    for of, _ in classes:
        library = set(bytes(tiktoken.Encoding("class", pat_str=of, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        package = set(regex.findall(of, every))
        out |= {ord(c): 0xE000 for c in package - library}
        out |= {ord(c): dict(classes)[of] for c in library - package}
    return out


class Codec:
    """Encoder and decoder of one worker process over a DuckDB database of merges and spellings."""

    def __init__(self, tokens: list[bytes], pattern: str, others: dict[int, int], memory: str = "400MB"):
        import duckdb
        import regex

        self.split, self.ids = regex.compile(pattern), {t: i for i, t in enumerate(tokens)}
        self.others, self.odd = others, np.zeros(0x110000, bool)
        self.odd[list(others)] = True
        ids = self.ids
        rows = [(ids[t[:k]], ids[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        first, second, made = (np.array(c, np.int32) for c in zip(*rows)) if rows else (np.zeros(0, np.int32),) * 3
        rivals: dict[int, set[int]] = {}
        for one, other, rank in rows:
            if rank < one:
                rivals.setdefault(one, set()).add(other)
            if rank < other:
                rivals.setdefault(other, set()).add(one)
        self.base = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        within = np.zeros(1 << 16, bool)
        for token in tokens:
            pair = np.frombuffer(token, np.uint8).astype(np.int32)
            within[pair[:-1] * 256 + pair[1:]] = True
        self.within, self.memo = within, {}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        self._table("merges", first=first, second=second, merged=made)
        self._table("rivals", id=pa.array(list(rivals), pa.int32()), tokens=pa.array([sorted(v) for v in rivals.values()], pa.list_(pa.int32())))
        spelling = ["".join(chr(256 + b) for b in t) for t in tokens]
        self._table("vocabulary", id=np.arange(len(tokens), dtype=np.int32), spelling=spelling)

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are not tokens themselves, by the recursive queries over their bytes."""
        out: list[bytes] = [b""] * len(words)
        for query, places in (
            (ENCODE, [i for i, w in enumerate(words) if len(w) <= LONG_WORD]), (ENCODE_LONG, [i for i, w in enumerate(words) if len(w) > LONG_WORD])
        ):
            if places:
                for i, ids in zip(places, self._contract([words[i] for i in places], query)):
                    out[i] = ids
        return out

    def _contract(self, words: list[bytes], query: str) -> list[bytes]:
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        starts = np.cumsum([0, *map(len, words)])
        cut = np.ones(len(flat), bool)
        # No merge crosses two bytes that no token holds side by side.
        cut[1:] = ~self.within[flat[:-1] * 256 + flat[1:]]
        cut[starts[:-1]] = True
        self.db.register("start", pa.table({"seg": pa.array(np.cumsum(cut)), "pos": pa.array(np.arange(len(flat))), "id": pa.array(self.base[flat])}))
        found = self.db.execute(query).fetchnumpy()
        self.db.unregister("start")
        at = np.searchsorted(found["pos"], starts)
        ids = found["id"].astype("<u4").tobytes()
        return [ids[4 * a:4 * b] for a, b in zip(at.tolist(), at[1:].tolist())]

    def words(self, text: str) -> list[str]:
        if text.isascii() or not self.odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return self.split.findall(text)
        return [text[m.start():m.end()] for m in self.split.finditer(text.translate(self.others))]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. Words met before come from the memo, words that are tokens from the vocabulary."""
        pieces = [self.words(t) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, new, once = self.memo, [], {}
        for word in set().union(*pieces):
            if word not in memo:
                known = self.ids.get(word.encode())
                if known is None:
                    new.append(word)
                else:
                    memo[word] = known.to_bytes(4, "little")
        low = 0
        while low < len(new):
            high, taken = low, 0
            while high < len(new) and (high == low or taken < SLICE_CHARS // 8):
                taken, high = taken + len(new[high]), high + 1
            for word, ids in zip(new[low:high], self.contract([w.encode() for w in new[low:high]])):
                (memo if len(word) < 64 else once)[word] = ids
            low = high
        if once:
            memo = {w: once[w] if w in once else memo[w] for p in pieces for w in p}
        for words in pieces:
            yield np.frombuffer(b"".join(map(memo.__getitem__, words)), "<u4")

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes that each list of ids spells."""
        flat = np.concatenate(ids)
        docs = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        self.db.register("stream", pa.table({"doc": pa.array(docs), "pos": pa.array(np.arange(len(flat))), "id": pa.array(flat.astype(np.int32))}))
        found = self.db.execute(DECODE).fetchall()
        self.db.unregister("stream")
        out = [b""] * len(ids)
        for doc, body in found:
            # Two bytes a character, the lower one first.
            out[doc] = body.encode("utf-16-le")[::2]
        return out


def _codec(tokens: list[bytes], pattern: str, others: dict[int, int]) -> Codec:
    """The worker process's codec: workers outlive tasks, while functions that travel by value do not."""
    import duckdb

    key = hashlib.sha256(repr((pattern, tokens, others)).encode()).hexdigest()
    held = duckdb.__dict__.setdefault("_bpe_codecs", {})
    if key not in held:
        held[key] = Codec(tokens, pattern, others)
    return held[key]


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    low, held = 0, 0
    for high, size in enumerate(sizes):
        if held and held + size > most:
            yield low, high
            low, held = high, 0
        held += size
    if low < len(sizes):
        yield low, len(sizes)


def _digests(codec: Codec, ids: list[np.ndarray]) -> list[str]:
    """SHA-256 of what each list of ids decodes to, long lists block by block."""
    hashes = [hashlib.sha256() for _ in ids]
    for low, high in _groups([len(x) for x in ids], DECODE_ROWS):
        if high == low + 1:
            for at in range(0, len(ids[low]), DECODE_ROWS):
                hashes[low].update(codec.decode([ids[low][at:at + DECODE_ROWS]])[0])
        else:
            for one, body in zip(hashes[low:high], codec.decode(ids[low:high])):
                one.update(body)
    return [h.hexdigest() for h in hashes]


def _coded(held, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*held.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = pc.binary_length(texts).to_pylist()
            for low, high in _groups(sizes, SLICE_CHARS):
                plain_texts = [b.decode("utf-8", "replace") for b in texts.slice(low, high - low).to_pylist()]
                ids = list(codec.encode(plain_texts))
                columns = [
                    keys.slice(low, high - low), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array(_digests(codec, ids), pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.view("<i4") for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                trim_worker()

    return run


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``.

    ``path`` is a rank file (base64 token and rank a line), read by the driver and broadcast: its size does not grow with
    the data. Every match of ``pattern`` is encoded on its own: a match that is a token is that token, the bytes
    of any other are contracted at the leftmost pair of least rank until no pair has a rank. Nothing is shuffled.
    ``ids_sha256`` covers the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` the bytes they decode to.

    A null text is the empty text and has no ids. Ids of documents may repeat or be null; rows stay rows. Bytes that are
    not UTF-8 become U+FFFD first. Texts are encoded and decoded whole, long ones in blocks of rows; one word without
    a break must fit a worker's memory. No rows give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast((ranks_of(path), pattern, stand_ins()))
    chosen = plain(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(f"`{text_col}`").cast("binary").alias("text"))
    fields = [T.StructField("doc_id", chosen.schema["doc_id"].dataType), *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return chosen.mapInArrow(_coded(held, with_ids), T.StructType(fields))


def _spelt(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*held.value)
        for batch in batches:
            keys, lists = batch.column(0), [np.asarray(x, "<u4") for x in batch.column(1).to_pylist()]
            for low, high in _groups([len(x) for x in lists], DECODE_ROWS):
                bodies = [b"".join(codec.decode([x[at:at + DECODE_ROWS]])[0] for at in range(0, len(x), DECODE_ROWS)) for x in lists[low:high]] if high == low + 1 else codec.decode(lists[low:high])
                yield pa.RecordBatch.from_arrays([keys.slice(low, high - low), pa.array([b.decode("utf-8", "replace") for b in bodies], pa.string())], names=["doc_id", "text"])
            trim_worker()

    return run


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of rows of ids, by ordered aggregation of spellings; a null list is empty, as is its text."""
    held = rows.sparkSession.sparkContext.broadcast((ranks_of(path), "", {}))
    chosen = plain(rows, id_col, ids_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return chosen.mapInArrow(_spelt(held), T.StructType([T.StructField("doc_id", chosen.schema["doc_id"].dataType), T.StructField("text", T.StringType())]))
