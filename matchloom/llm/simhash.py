"""SimHash near-dedup: fingerprints of word shingles, linked by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.plans.durable import spool

from .common import plain, trim_worker, whole_text
from .components import components

BITS = 64
SEED = 42
#: Work of dealing out one key row, in verified pairs.
ROW_COST = 200.0


def fingerprint(words: list[bytes], width: int, seed: int = SEED) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes; no words give zero."""
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return majority([digest(b" ".join(words[i:i + width]), seed) for i in range(low, min(n, low + 65_536))] for low in range(0, n, 65_536))


def majority(blocks: Iterable[Sequence[int]]) -> int:
    """The bits set in over half of the hashes, which come in blocks."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for hashes in blocks:
        n += len(hashes)
        ones += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(width: int, second: bool):
    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, other = [], []
            for text in batch.column(1).cast(pa.binary()):
                words = text.as_py().lower().split()  # bytes: only A-Z change, only ASCII white space cuts
                first.append(signed(fingerprint(words, width)))
                other.append(signed(fingerprint(words, width, SEED + 1)) if second else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.int64()), pa.array(other, pa.int64())], names=["doc_id", "fp", "fp2"])
            trim_worker()

    return run


# ---- choice of partitions and thresholds


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones per bit and the bits' correlations, counted over all of them."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            bits = ((values[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(BITS * BITS + 1), pa.int32()), "count": pa.array([n, *both.ravel().astype(np.int64)], pa.int64())})

    counted = prints.select("fp").mapInArrow(run, "at int, count long").groupBy("at").agg(F.sum("count").alias("count"))
    got = dict(counted.collect())  # 4,097 numbers
    n = got.get(0, 0)
    both = np.array([got.get(1 + i, 0) for i in range(BITS * BITS)], dtype=float).reshape(BITS, BITS) / max(n, 1)
    ones = np.diag(both)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    return n, ones, (both - np.outer(ones, ones)) / np.outer(spread, spread)


def group_bits(related: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into ``parts`` groups of equal width, each grown by the bit most correlated with it so far."""
    free, out = set(range(BITS)), []
    strength = np.abs(related) - np.eye(BITS) * np.abs(related)
    for p in range(parts):
        width = BITS // parts + (p < BITS % parts)
        group = [max(free, key=lambda b: (strength[b, sorted(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allocate(n: int, ones: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of the groups with the least estimated work, by dynamic programming.

    If the thresholds sum to distance - groups + 1, two fingerprints within ``distance`` are within the threshold in
    at least one group; -1 leaves a group out. Work is the key rows dealt out plus the pairs verified; pairs follow
    from the chance that two fingerprints differ in at most so many bits of the group.
    """
    total = distance - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        differ, chance = 2 * ones[group] * (1 - ones[group]), np.array([1.0])
        for d in differ:
            chance = np.append(chance * (1 - d), 0) + np.append(0, chance * d)
        within = np.cumsum(chance)
        after: dict[int, tuple[float, list[int]]] = {}
        for t in range(-1, min(distance, len(group)) + 1):
            rows = 0.0 if t < 0 else 1 + sum(math.comb(len(group), k) for k in range(1, t + 1)) / 2
            work = 0.0 if t < 0 else n * rows * ROW_COST + n * n / 2 * within[t]
            for used, (cost, chosen) in best.items():
                key = used + t
                if key not in after or cost + work < after[key][0]:
                    after[key] = (cost + work, [*chosen, t])
        best = after
    return best[total]


def plan(prints: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the probed groups for fingerprints within ``distance``."""
    n, ones, related = bit_statistics(prints)
    options = []
    for parts in range(1, distance + 2):
        groups = group_bits(related, parts)
        cost, thresholds = allocate(n, ones, groups, distance)
        if sum(math.comb(len(g), k) for g, t in zip(groups, thresholds) for k in range(t + 1)) <= 4000:
            options.append((cost, groups, thresholds))
    _, groups, thresholds = min(options, key=lambda o: o[0])
    return [(g, t) for g, t in zip(groups, thresholds) if t >= 0]


# ---- probing and verification


def probe_keys(prints: DataFrame, probes: list[tuple[list[int], int]]) -> DataFrame:
    """Key rows (part, key, fp, fp2, node, own): a fingerprint's own bits in a group, and larger values near them.

    Of two fingerprints that differ within the threshold, the one with the smaller value probes the other's.
    """
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    out = None
    for part, (bits, threshold) in enumerate(probes):
        mask = F.lit(signed(sum(1 << b for b in bits))).cast("long")
        flips = [signed(sum(1 << b for b in c)) for k in range(threshold + 1) for c in combinations(bits, k)]
        own = F.col("fp").bitwiseAND(mask)
        rows = prints.select(F.lit(part).alias("part"), own.alias("value"), "fp", "fp2", "node", F.explode(F.lit(flips).cast("array<bigint>")).alias("flip"))
        rows = rows.withColumn("key", F.col("value").bitwiseXOR(F.col("flip"))).filter("flip = 0 OR key > value")
        rows = rows.select("part", "key", "fp", "fp2", "node", (F.col("flip") == 0).alias("own"))
        out = rows if out is None else out.unionAll(rows)
    return out


def _verify(distance: int, second: int | None):
    """Links of a cell that make a spanning forest of its members' links.

    Trees grow from the smallest node and reach nodes in ascending order, so that cells of other keys that hold the
    same nodes mostly name the same links.
    """

    def forest(fp, fp2, node, row):
        rising = np.argsort(node, kind="stable")
        rows, columns = rising[row[rising]], rising[~row[rising]]
        linked = np.zeros((len(rows), len(columns)), bool)
        for low in range(0, len(rows), 256):
            some = rows[low:low + 256]
            near = np.bitwise_count(fp[some, None] ^ fp[None, columns])
            good = near <= distance
            if second is not None:
                good &= near + np.bitwise_count(fp2[some, None] ^ fp2[None, columns]) <= second
            good &= node[some, None] != node[None, columns]
            linked[low:low + 256] = good
        todo, fresh = linked.any(axis=1), np.ones(len(columns), bool)
        while todo.any():
            # One tree: from rows to columns not reached before and back to rows.
            front = [int(np.argmax(todo))]
            todo[front] = False
            while front:
                following: list[int] = []
                for a in front:
                    reached = np.flatnonzero(linked[a] & fresh)
                    fresh[reached] = False
                    for b in reached:
                        yield node[rows[a]], node[columns[b]]
                        for c in np.flatnonzero(linked[:, b] & todo):
                            yield node[rows[c]], node[columns[b]]
                            todo[c] = False
                            following.append(int(c))
                front = following

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            bounds = members.offsets.to_numpy()
            get = lambda k: members.values.field(k).to_numpy(zero_copy_only=False)
            fp, fp2, node, row = get("fp").view(np.uint64), get("fp2").view(np.uint64), get("node"), get("row")
            links: list = []
            for low, high in zip(bounds, bounds[1:]):
                links += forest(fp[low:high], fp2[low:high], node[low:high], row[low:high])
            u, v = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def link(prints: DataFrame, distance: int, second: int | None = None, cell_rows: int = 1024) -> DataFrame:
    """Links (u, v) between nodes of ``prints`` (node, fp, fp2) whose components equal those of all links.

    Keys are counted first, combined on the map side, and keys of one fingerprint dropped. A key's owners and all its
    members are dealt by hash into blocks of about ``cell_rows``; each pair of blocks is a cell of its own, which yields
    a spanning forest of its links, so neither a task's memory nor the output grows with the square of a key's members.
    """
    keys = probe_keys(prints, plan(prints, distance))
    crowds = keys.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("long")).alias("owners")).filter("n > 1 AND owners > 0")
    blocks = lambda c: F.ceil(F.col(c) / cell_rows).cast("int")
    crowds = spool(crowds.select("part", "key", blocks("n").alias("wide"), blocks("owners").alias("high")), "keys")
    members = keys.join(crowds, ["part", "key"])
    at = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    cell = lambda a, b, row: F.struct(a.alias("a"), b.alias("b"), F.lit(row).alias("row"))
    as_column = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda a: cell(a, at("wide"), False))
    as_row = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda b: cell(at("high"), b, True))
    dealt = members.withColumn("cell", F.explode(F.when(F.col("own"), F.concat(as_column, as_row)).otherwise(as_column)))
    cells = dealt.groupBy("part", "key", "cell.a", "cell.b").agg(F.collect_list(F.struct("fp", "fp2", "node", "cell.row")).alias("members"))
    return cells.select("members").mapInArrow(_verify(distance, second), "u long, v long")


def radius(similarity: float) -> dict[str, int]:
    """Distances for ``near_duplicates`` that stand for a Jaccard similarity of shingles.

    Sets of similarity s have a cosine of about 2 s / (1 + s), and a bit differs with the angle's share of a half turn.
    The first fingerprint may differ by a standard deviation more than expected, both together by half of one.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    spread = lambda bits: math.sqrt(bits * share * (1 - share))
    return {"distance": int(BITS * share + spread(BITS)), "second": int(2 * BITS * share + spread(2 * BITS) / 2)}


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, second: int | None = None, cell_rows: int = 1024,
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable).

    Fingerprints link at ``distance`` or fewer differing bits; equal fingerprints are one node. With ``second`` a
    fingerprint of another seed is taken too, and the two together may differ in at most ``second`` bits, which keeps
    unrelated texts apart at larger distances. Null and empty texts have fingerprint zero and link like any other;
    texts of fewer than ``width`` words are one shingle. Null ids are never the smallest; a component of null ids
    only has a null id. Rows that repeat an id keep a fingerprint each. No rows give no rows.
    """
    rows = plain(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    marked = rows.mapInArrow(_fingerprints(width, second is not None), "doc_id long, fp long, fp2 long")
    node = F.col("fp") if second is None else F.xxhash64("fp", "fp2")
    marked = spool(marked.withColumn("node", node), "fingerprints")
    prints = spool(marked.groupBy("node", "fp", "fp2").agg(F.min("doc_id").alias("least")), "nodes")
    rooted = components(link(prints.select("node", "fp", "fp2"), distance, second, cell_rows))
    tops = prints.select("node", "least").join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    tops = spool(tops, "roots")
    named = tops.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = spool(tops.select("node", "root").join(named, "root").select("node", "component_id"), "classes")
    return marked.join(classes, "node").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
