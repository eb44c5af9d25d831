"""Near copies by Jaccard similarity of word shingles: SimHash classes and MinHash bands find candidate pairs, sketches sift them, the shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.plans.durable import spool

from . import simhash
from .common import spool_small, trim_worker
from .components import components

#: A pair of similarity s shares no key with probability (1 - s**DEPTH)**BANDS: 7e-5 at 0.8, 3e-7 at 0.85.
BANDS, DEPTH = 24, 5
SEED = 42
#: Fingerprints that differ in at most this many bits link to a class, whose members are candidates of each other.
DISTANCE = 4
#: A sketch holds four bits of each MinHash value, fifteen to a long. A pair is compared if its sketches' estimate of the
#: similarity is at most MARGIN below the limit: four standard deviations at 0.8, so 3e-5 of such pairs are lost.
TO_A_LONG, MARGIN = 15, 0.15
#: Rounds that compare each member of a band's group with one other only, before all pairs not yet connected are compared.
STAR_ROUNDS = 2
#: Keys with up to FEW members have their pairs joined; the members of others are dealt to blocks of these many rows and hashes.
FEW, BLOCK_ROWS, BLOCK_HASHES = 16, 1024, 1 << 17


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """64-bit hashes of the shingles, repeats included; a text of fewer than ``width`` words is one shingle, one without words none."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space cuts
    if not words:
        return np.array([], np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    return np.fromiter((digest(b" ".join(words[i:i + width]), SEED) for i in range(n)), np.uint64, n)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, width))


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The least values of BANDS * DEPTH random linear maps."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 63, BANDS * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 64, BANDS * DEPTH, np.uint64)
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max)
    for low in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[low:low + 2048, None] * factors + shifts).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A key of each band of DEPTH values."""
    return [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, DEPTH))]


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each value; not the highest, which are zero in a least value."""
    bits = (least >> np.uint64(20) & np.uint64(15)).reshape(-1, TO_A_LONG)
    return np.bitwise_or.reduce(bits << np.arange(0, 4 * TO_A_LONG, 4, dtype=np.uint64), axis=1)


def alike(one: str, other: str, similarity: float) -> Column:
    """Whether two columns of sketches allow for the similarity: unequal values agree in four bits once in sixteen times."""
    differing = F.lit(0)
    for k in range(BANDS * DEPTH // TO_A_LONG):
        bits = F.col(one)[k].bitwiseXOR(F.col(other)[k])
        bits = bits.bitwiseOR(F.shiftright(bits, 2))
        bits = bits.bitwiseOR(F.shiftright(bits, 1)).bitwiseAND(F.lit(int("1" * TO_A_LONG, 16)))
        differing = differing + F.bit_count(bits)
    return differing <= int(BANDS * DEPTH * (1 - max(0.0, similarity - MARGIN)) * 15 / 16)


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _mark(text_col: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, keys, sketches = [], [], [], [], []
            for text in batch.column(batch.schema.get_field_index(text_col)):
                each = shingle_hashes((text.as_py() or "").encode(), width)
                prints.append(simhash.majority(each[low:low + 65_536] for low in range(0, len(each), 65_536)))
                hashes = np.unique(each)
                least = least_values(hashes)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                keys.append(_signed(band_keys(least) if len(hashes) else []))
                sketches.append(_signed(sketch(least)))
            lists = pa.list_(pa.int64())
            more = [pa.array(_signed(nodes)), pa.array(sizes, pa.int64()), pa.array(_signed(prints)), pa.array(keys, lists), pa.array(sketches, lists)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_node", "_size", "_print", "_keys", "_sketch"])
            trim_worker()

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set((t.as_py() or "").encode(), width).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["node", "shingles"])
            trim_worker()

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of ``similarity`` or more; only their sets travel."""
    ends = spool(pairs.select("u").unionAll(pairs.select("v")).distinct().withColumnRenamed("u", "node"), "ends")
    some = sets.join(ends, "node", "left_semi")
    side = lambda name: some.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_set"))
    joined = pairs.join(side("u"), "u").join(side("v"), "v")
    shared = F.size(F.array_intersect("u_set", "v_set"))
    return joined.filter(shared >= F.lit(similarity) * (F.size("u_set") + F.size("v_set") - shared)).select("u", "v")


def _forest(similarity: float):
    """Links of a cell that join the parts of its members as all its near copies would; no more than its members."""

    def run(cell: pa.Table) -> pa.Table:
        node, at = cell["node"].to_numpy(), cell["at"].to_numpy()
        part = np.unique(cell["root"].to_numpy(), return_inverse=True)[1]
        u: list[int] = []
        v: list[int] = []
        if part.any():
            sets = cell["shingles"].combine_chunks()
            bounds = sets.offsets.to_numpy()
            sizes = np.diff(bounds)
            _, code, times = np.unique(sets.values.to_numpy()[bounds[0]:bounds[-1]], return_inverse=True, return_counts=True)
            # Hashes of one member only are shared by no pair; the others are numbered and met in blocks of columns.
            common = times > 1
            owner, code = np.repeat(np.arange(len(node)), sizes)[common[code]], (np.cumsum(common) - 1)[code[common[code]]]
            rising = np.argsort(code, kind="stable")
            owner, code = owner[rising], code[rising]
            left, right = np.flatnonzero(at == at.min()), np.flatnonzero(at == at.max())
            shared = np.zeros((len(left), len(right)))
            for low in range(0, int(common.sum()), 2048):
                first, last = np.searchsorted(code, (low, low + 2048))
                held = np.zeros((len(node), 2048), np.float32)
                held[owner[first:last], code[first:last] - low] = 1
                shared += held[left] @ held[right].T
            near = shared >= similarity * (sizes[left][:, None] + sizes[right] - shared)
            for a, row in zip(left, near):
                found = right[row]
                parts, firsts = np.unique(part[found], return_index=True)
                other = parts != part[a]
                u += [node[a]] * int(other.sum())
                v += list(node[found[firsts[other]]])
                part[np.isin(part, parts[other])] = part[a]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def cell_links(crowds: DataFrame, sets: DataFrame, similarity: float, block_rows: int, block_hashes: int) -> DataFrame:
    """Links (u, v) that connect the ``crowds`` (key, node, root, n, hashes) as all near copies that share a key would.

    A key's members are dealt by hash to blocks of bounded rows and hashes. Each pair of blocks is a cell of its own that
    compares whole sets and yields no more links than it has members, so no output grows with the square of a key.
    """
    wide = F.ceil(F.greatest(F.col("n") / block_rows, F.col("hashes") / block_hashes)).cast("int")
    placed = crowds.select("key", "node", "root", wide.alias("wide")).withColumn("at", F.pmod(F.xxhash64("node"), F.col("wide")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    dealt = dealt.select("key", F.least("at", "other").alias("a"), F.greatest("at", "other").alias("b"), "at", "node", "root")
    return dealt.join(sets, "node").groupBy("key", "a", "b").applyInArrow(_forest(similarity), "u long, v long").distinct()


def link(
    members: DataFrame, sets: DataFrame, similarity: float, star_rounds: int = STAR_ROUNDS, few: int = FEW, block_rows: int = BLOCK_ROWS, block_hashes: int = BLOCK_HASHES,
) -> DataFrame | None:
    """(node, root) of the components of all pairs of ``members`` (key, node, size, sketch) that share a key and are near copies.

    A round compares the members of a key with one of them, drawn anew, and leaves out those connected with it already;
    so a large group of near copies costs no square of its size. As soon as the pairs not yet connected are few, and
    after ``star_rounds`` rounds in any case, all of them are compared: pairs of keys with up to ``few`` members by a join,
    the rest in cells of bounded size. None without members that share a key.
    """
    links = roots = None
    for turn in range(star_rounds + 1):
        now = members.withColumn("root", F.col("node"))
        if roots is not None:
            now = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parts = now.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("size").alias("hashes"))
        pairs = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2
        open_ = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("hashes").alias("hashes"), pairs.alias("pairs"), F.max(F.struct("n", "root")).alias("top"))
        open_ = spool(open_.filter("pairs > 0").select("key", "n", "hashes", "pairs", F.col("top.root").alias("top")), "open-keys")
        rows, todo = open_.agg(F.sum("n"), F.sum("pairs")).first()
        if not todo:
            break
        last = turn == star_rounds or todo <= 2 * rows
        now = spool(now.join(open_.select("key", "n", "hashes", "top"), "key"), "open-members")
        if last:
            # The largest part of a key is met by the others and not by itself.
            now, crowds = now.filter(F.col("n") <= few), now.filter(F.col("n") > few)
            other = now.select("key", *(F.col(c).alias(f"{c}2") for c in ("node", "size", "sketch", "root")))
            found = now.filter("root <> top").join(other, "key").filter("root2 = top OR root < root2")
        else:
            drawn = F.struct(F.xxhash64("node", F.lit(turn)).alias("at"), *(F.col(c).alias(f"{c}2") for c in ("node", "size", "sketch", "root")))
            other = now.groupBy("key").agg(F.min(drawn).alias("one")).select("key", "one.node2", "one.size2", "one.sketch2", "one.root2")
            found = now.join(other, "key").filter("root <> root2")
        found = found.filter(F.least("size", "size2") >= F.lit(similarity) * F.greatest("size", "size2")).filter(alike("sketch", "sketch2", similarity))
        pairs = spool(found.select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).distinct(), "pairs")
        near = verified(pairs, sets, similarity)
        if last:
            near = near.unionAll(cell_links(crowds, sets, similarity, block_rows, block_hashes))
        near = spool(near, "near")
        links = near if links is None else links.unionAll(near)
        roots = spool(components(links), "roots")
        if last:
            break
    return roots


def marked(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """The rows with ``_node`` (hash of the shingle set), ``_size``, ``_print`` (SimHash), ``_keys``, ``_sketch`` and ``_row``, which is unique; written once."""
    longs = T.ArrayType(T.LongType())
    more = [T.StructField(name, kind) for name, kind in (("_node", T.LongType()), ("_size", T.LongType()), ("_print", T.LongType()), ("_keys", longs), ("_sketch", longs))]
    rows = docs.mapInArrow(_mark(text_col, width), T.StructType([*docs.schema.fields, *more]))
    return spool_small(rows.withColumn("_row", F.monotonically_increasing_id()), "marked")


def class_keys(rows: DataFrame, distance: int) -> DataFrame:
    """(node, size, key) of the rows of :func:`marked` that have words; the key is their SimHash class."""
    worded = rows.filter("_size > 0").select(F.col("_node").alias("node"), F.col("_size").alias("size"), F.col("_print").alias("print")).distinct()
    prints = spool(worded.select("print").distinct().select(F.col("print").alias("node"), F.col("print").alias("fp"), F.lit(0).cast("long").alias("fp2")), "prints")
    classes = spool(components(simhash.link(prints, distance)).select(F.col("node").alias("print"), "root"), "classes")
    keyed = worded.join(classes, "print", "left").select("node", "size", F.xxhash64(F.lit("class"), F.coalesce("root", "print")).alias("key"))
    return spool(keyed.distinct(), "class-keys")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, star_rounds: int = STAR_ROUNDS, few: int = FEW,
    block_rows: int = BLOCK_ROWS, block_hashes: int = BLOCK_HASHES, distance: int = DISTANCE,
) -> DataFrame:
    """One row of each group of near copies, with all columns: the one with the smallest id.

    Rows are near copies if the sets of their ``width``-word shingles have a Jaccard similarity of ``similarity`` or
    more, and groups are the components of these pairs. Candidate pairs share a SimHash class (fingerprints that differ in
    up to ``distance`` bits, one step after the other) or a MinHash key; each is compared by its whole sets of 64-bit
    shingle hashes. Every row is judged by its own text: rows without an id or with a repeated id
    stay unless they are near copies themselves. Null ids come last; ties go by a hash of the row, and one of equal rows
    stays. Null and empty texts are copies of each other. Columns may have any names: they are numbered while at work.
    """
    names = docs.columns
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    rows = marked(docs, text_col, width)
    keyed = rows.select(F.col("_node").alias("node"), F.col("_size").alias("size"), F.explode("_keys").alias("key")).unionAll(class_keys(rows, distance))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("key")
    order = F.struct(
        F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"),
        F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if "map<" not in kind)).alias("tie"), F.col("_row").alias("row"),
    )
    nodes = spool(rows.groupBy("_node").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("_sketch").alias("sketch")), "nodes")
    sharing = keyed.join(spool(shared, "keys"), "key").select("key", "node", "size").distinct()
    members = spool(sharing.join(nodes.select(F.col("_node").alias("node"), "sketch"), "node"), "members")
    wanted = nodes.join(members.select(F.col("node").alias("_node")).distinct(), "_node").select(F.col("first.row").alias("_row"))
    texts = rows.select("_node", F.col(text_col).cast("string").alias("text"), "_row").join(spool(wanted, "candidates"), "_row", "left_semi")
    sets = spool(texts.select("_node", "text").mapInArrow(_sets(width), "node long, shingles array<bigint>"), "sets")
    roots = link(members, sets, similarity, star_rounds, few, block_rows, block_hashes)
    nodes = nodes.drop("sketch")
    grouped = nodes.withColumn("root", F.col("_node"))
    if roots is not None:
        grouped = nodes.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    grouped = spool(grouped, "grouped")
    kept = grouped.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1").select("root", F.col("first.row").alias("kept"))
    kept = spool(grouped.select("_node", "root").join(kept, "root").select("_node", "kept"), "kept")
    gone = spool(rows.select("_node", "_row").join(kept, "_node").filter("_row <> kept").select("_row"), "gone")
    return rows.join(gone, "_row", "left_anti").select(*(F.col(f"c{k}").alias(name) for k, name in enumerate(names)))
