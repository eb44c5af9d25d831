"""Token ids in shuffled planes: fixed-size blocks of ids, transposed, compressed plane by plane, with an index."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import plain, slices, trim_worker, whole_text

#: Ids in a block; a block holds the ids of several documents or a part of one.
BLOCK_IDS = 65_536
#: Bytes of text encoded at once: each distinct piece of them is looked up once.
SLICE = 8_000_000
BLOCKS = (
    "shard int, block int, first long, n int, kind string, planes array<binary>, "
    "docs array<struct<place: long, doc_id: long, at: long, n: int, total: long>>"
)
PIECES = "shard int, place long, doc_id long, start long, n_tokens long, at long, n int, ids_crc32 long, ids binary"


#: White space other than single spaces and single line feeds between other characters, and the mark used for cutting.
UNEVEN = (
    r"  |\n\n| \n|\n |^[ \n]|[ \n]$|[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


class Encoder:
    """Ids of texts by the tokenizers library; words met before are taken from a bounded memo.

    Byte-level pre-tokens never cross the point before a single space or around a single line feed between characters
    that are not white space, nor that between a letter and a full stop or comma; texts are cut there and each
    distinct piece is encoded once. Texts with other white space go to the library whole.
    """

    def __init__(self, definition: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.memo = Tokenizer.from_str(definition), most, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        # Byte-level tokens are spelled with one character for each byte.
        self.widths = np.zeros(max([*self.tokenizer.get_vocab().values(), 0]) + 1, np.int64)
        self.widths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        for number, token in self.tokenizer.get_added_tokens_decoder().items():
            self.widths[number] = len(token.content.encode())
        self.joins = len(self.coded(["\n"])[0]) == 4

    def coded(self, texts: list[str]) -> list[bytes]:
        return [np.array(c.ids, dtype="<u4").tobytes() for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def coded_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of even texts: many are encoded as one text, in which each begins with a space or follows a line feed.

        Ids are dealt back by the bytes that they stand for. Should these not end where the pieces end, or a piece be
        a line feed or empty, pieces are encoded one by one.
        """
        if not self.joins or "\n" in pieces or "" in pieces:
            plain = [w for w in pieces if w not in ("", "\n")]
            if not self.joins or len(plain) == len(pieces):
                return self.coded(pieces)
            known = {w: c for w, c in zip(("", "\n"), self.coded(["", "\n"]))}
            rest = iter(self.coded_pieces(plain) if plain else [])
            return [known[w] if w in known else next(rest) for w in pieces]
        led = np.array([w[0] != " " for w in pieces])
        texts = ["".join([w if w[0] == " " else "\n" + w for w in pieces[i:i + 256]]) for i in range(0, len(pieces), 256)]
        flat = np.concatenate([np.array(c.ids, dtype="<u4") for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(pc.binary_length(pa.array(pieces, pa.string())).to_numpy() + led, dtype=np.int64)
        bytes_to = np.append(0, np.cumsum(self.widths[flat]))
        last = np.searchsorted(bytes_to, ends)
        if bytes_to[-1] != ends[-1] or (bytes_to[last] != ends).any():
            return self.coded(pieces)
        raw, first = flat.tobytes(), np.append(0, last[:-1]) + led
        return [raw[a:b] for a, b in zip((4 * first).tolist(), (4 * last).tolist())]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        whole = np.flatnonzero(uneven)
        for i, ids in zip(whole, self.coded(texts.take(whole).to_pylist()) if len(whole) else []):
            out[i] = np.frombuffer(ids, dtype="<u4")
        even = np.flatnonzero(~uneven)
        if not len(even):
            return out
        marked = pc.replace_substring(pc.replace_substring(texts.take(even), " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(pc.replace_substring_regex(marked, r"(\p{L})([.,])", "\\1\0\\2"), "\0")
        encoded = lists.flatten().dictionary_encode()
        words, at = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
        if len(self.memo) > self.most:
            # The words of the texts at hand stay: frequent ones are among them.
            self.memo = {w: self.memo[w] for w in words if w in self.memo}
        memo = self.memo
        new = [w for w in words if w not in memo]
        once = {}
        for start in range(0, len(new), 10_000):
            some = new[start:start + 10_000]
            for word, ids in zip(some, self.coded_pieces(some)):
                (memo if len(word) < 64 else once)[word] = ids
        ids = [memo[w] if w in memo else once[w] for w in words]
        sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        firsts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), dtype="<u4")
        each = sizes[at]
        ends = np.cumsum(each)
        # The n-th id of a piece stands n places after the first id of its word.
        stream = flat[np.repeat(firsts[at] - ends + each, each) + np.arange(ends[-1])]
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bounds = np.append(0, ends)[cuts]
        for i, low, high in zip(even, bounds, bounds[1:]):
            out[i] = stream[low:high]
        return out


def _encoder(definition: str) -> Encoder:
    """The worker process's encoder: workers outlive tasks, while functions that travel by value do not."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_encoders", {})
    if definition not in held:
        held[definition] = Encoder(definition)
    return held[definition]


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """zstandard frames of the planes that have a bit set, lowest first."""
    parts = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        parts = np.unpackbits(parts, axis=1, bitorder="little")
    used = int(np.flatnonzero(parts.any(axis=0)).max(initial=-1)) + 1
    planes = np.ascontiguousarray(parts[:, :used].T)
    if kind == "bit":
        planes = np.packbits(planes, axis=1, bitorder="little")
    pressed = zstandard.ZstdCompressor(level=3)
    return [pressed.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    raw = zstandard.ZstdDecompressor()
    wide = np.zeros((32 if kind == "bit" else 4, n), np.uint8)
    for k, plane in enumerate(planes):
        got = np.frombuffer(raw.decompress(plane), np.uint8)
        wide[k] = np.unpackbits(got, bitorder="little")[:n] if kind == "bit" else got
    parts = np.ascontiguousarray(wide.T)
    if kind == "bit":
        parts = np.packbits(parts, axis=1, bitorder="little")
    return np.ascontiguousarray(parts).view("<u4").ravel()


def _blocks(definition, end_id: int, kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(definition.value), TaskContext.get().partitionId()
        held, pieces, filled, made, place = [], [], 0, 0, 0
        schema = pa.schema([
            ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("kind", pa.string()), ("planes", pa.list_(pa.binary())),
            ("docs", pa.list_(pa.struct([("place", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("total", pa.int64())]))),
        ])

        def block():
            nonlocal held, pieces, filled, made
            ids = np.concatenate(held)
            row = {"shard": shard, "block": made, "first": made * size, "n": len(ids), "kind": kind, "planes": to_planes(ids, kind), "docs": pieces}
            held, pieces, filled, made = [], [], 0, made + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for low, high in slices(pc.binary_length(texts).to_pylist(), SLICE):
                for key, ids in zip(keys[low:high], encoder.encode(texts.slice(low, high - low))):
                    ids = np.append(ids, np.uint32(end_id))
                    at = 0
                    while at < len(ids):
                        n = min(size - filled, len(ids) - at)
                        held.append(ids[at:at + n])
                        pieces.append({"place": place, "doc_id": key, "at": at, "n": n, "total": len(ids)})
                        filled, at = filled + n, at + n
                        if filled == size:
                            yield block()
                    place += 1
                trim_worker()
        if filled:
            yield block()

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    kind: str = "byte", block_ids: int = BLOCK_IDS,
) -> None:
    """Write the ids of all documents in ascending id order under ``path``.

    Documents are dealt out by ranges of the id, so each task writes one shard and shards follow each other in id
    order. ``blocks/`` holds per block its planes (zstandard frames) and the documents it touches; ``index/`` holds
    per block its global first id, number of ids, bytes and first and last document. Both are Parquet, so that a
    lost task leaves nothing half written and any store will do. Null text is the empty text; a null id sorts first;
    rows with the same id follow in order of text, and each gets its own ids. Longer texts run over many blocks.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    rows = plain(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_blocks(definition, end_id, kind, block_ids), BLOCKS).write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    narrow = blocks.select(
        "shard", "block", "first", "n", F.element_at("docs", 1)["doc_id"].alias("first_doc"), F.element_at("docs", -1)["doc_id"].alias("last_doc"),
        F.aggregate("planes", F.lit(0).cast("long"), lambda s, p: s + F.octet_length(p)).alias("bytes"),
    )
    # One row per shard: the ids before each.
    totals = narrow.groupBy("shard").agg(F.sum("n").alias("ids"))
    bases = totals.select("shard", (F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("ids")).alias("base"))
    narrow.join(bases, "shard").select(
        "shard", "block", (F.col("base") + F.col("first")).alias("start"), "n", "bytes", "first_doc", "last_doc"
    ).write.parquet(f"{path}/index")


def _pieces(with_ids: bool):
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int32()] + [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids, low, rows = from_planes(b["planes"], b["n"], b["kind"]), 0, []
                for d in b["docs"]:
                    own = ids[low:low + d["n"]].tobytes()
                    whole = d["n"] == d["total"]
                    rows.append({
                        "shard": b["shard"], "place": d["place"], "doc_id": d["doc_id"], "start": b["start"] + low - d["at"], "n_tokens": d["total"],
                        "at": d["at"], "n": d["n"], "ids_crc32": zlib.crc32(own) if whole else None, "ids": own if with_ids or not whole else None,
                    })
                    low += d["n"]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per written document: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (little-endian unsigned 32-bit).

    Blocks are decoded apart from each other; only documents that cross a block's end are put together, by document.
    """
    from matchloom.plans.durable import spool

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    index = spark.read.schema("shard int, block int, start long").parquet(f"{path}/index")
    pieces = spool(blocks.join(index, ["shard", "block"]).select("shard", "n", "kind", "planes", "docs", "start").mapInArrow(_pieces(with_ids), PIECES), "pieces")
    columns = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    whole = pieces.filter("ids_crc32 IS NOT NULL").select(*columns)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda p: p["ids"])
    crossing = pieces.filter("ids_crc32 IS NULL").groupBy("shard", "place", "doc_id", "start", "n_tokens").agg(
        F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids")
    ).withColumn("ids_crc32", F.crc32("ids"))
    return whole.unionByName(crossing.select(*columns))
