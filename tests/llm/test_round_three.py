"""Filter audit, relational BPE and whitening beside plain loops, and on rows of every odd kind."""

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from matchloom.llm import bpe_rows, filter_audit, language, line_dedup, whitening

from test_operators import SCHEMA, as_rows, odd_rows, split

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0 if r[1] is None else len(r[1]), "x", 1, "y", 2, "z") for r in odd_rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def failed(rows):
    """{(row number): set of letters} by the conditions as they are stated."""
    first = defaultdict(lambda: None)
    for i, text, *_ in rows:
        if i is not None and (first[text or ""] is None or i < first[text or ""]):
            first[text or ""] = i
    out = []
    for i, text, *_ in rows:
        text, words = text or "", split(text)
        smallest = first[text]
        repeat = smallest is not None and (i is None or smallest < i)
        rules = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": repeat,
        }
        out.append({k for k, v in rules.items() if v})
    return out


def audited(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = defaultdict(list)
    for row, fails in zip(rows, failed(rows)):
        parts[row[2] or ""].append((row[0], fails))
    out, totals = [], Counter()
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = members
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                fails = sum(letter in f for _, f in members)
                out.append([part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(f == {letter} for _, f in members),
                            sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter])
                totals[part, letter] += len(gone)
    return sorted(tuple([*r[:-1], totals[r[0], r[-1]]]) for r in out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit(spark, docs, none):
    rng = random.Random(2)
    rows = [*odd_rows(), (300, "Loud WORDS # " * 90, "en", "a"), (301, "Loud WORDS # " * 90, "fr", "a"), (302, "loud words " * 150, "", "a")]
    rows += [(i, " ".join(rng.choice(("a", "B", "cc", "Dd|", "ee", f"w{rng.randrange(300)}")) for _ in range(rng.choice((50, 250)))), rng.choice(("en", "de")), "a") for i in range(400, 440)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i, *_ in rows if i is not None and rng.random() < 0.6]
    labels = list({i: (i, q, t) for i, q, t in labels}.values())
    table = spark.createDataFrame([(*r, 0, "x", 1, "y", 2, "z") for r in rows], SCHEMA).repartition(3)
    known = spark.createDataFrame([*labels, (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(as_rows(filter_audit.filter_audit(table, known), *AUDIT)) == audited(rows, labels)
    assert filter_audit.filter_audit(none, known.limit(0)).collect() == []
    # No label at all: zeros, not nulls.
    assert all(r["good_lost"] == 0 and r["shapley"] is not None for r in filter_audit.filter_audit(docs, known.limit(0)).collect())


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_lattice_counts(k):
    letters = "ABCD"[:k]
    used = Counter((state, bit) for _, _, state, bit in filter_audit.steps(letters))
    assert used == {(s, b): n for s, b, n in filter_audit.edges(k)}
    assert all(sum(n for s, b, n in filter_audit.edges(k) if b == 1 << f) == math.factorial(k) for f in range(k))


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_to_code():
    rng = random.Random(4)
    pools = ["abcdefgh ", "aAéèöß ñ\n\t  ", "日本語中文テキスト的是", "0123456789.,-_/'sdtm", "\u0085 ​ \x1c\x1d\x1e\x1f \r\n\x0b\x0c ab\0", "".join(chr(rng.randrange(32, 0x3000)) for _ in range(300))]
    made = ["".join(rng.choice(p) for _ in range(rng.randrange(60))) for p in pools for _ in range(60)]
    # Characters that are letters in one Unicode version only; words with many overlapping pairs; a word of 60,000 characters.
    made += ["\U00010ee7a \U00016ea7a ꟝a", "x" * 3000, "ab" * 1500, " " * 2000, "abcde" * 12_000, "aaab" * 700, "�\U0001f600 end"]
    return [*made, *(r[1] for r in odd_rows())]


def test_bpe_rows(spark, none):
    texts = texts_to_code()
    table = spark.createDataFrame([(i if i % 7 else None, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string").repartition(3)
    own = library()
    expected = Counter()
    for i, t in enumerate(texts):
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        expected[i if i % 7 else None, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    coded = bpe_rows.encoded(table, RANKS, public_tokenizers.PATTERN)
    assert Counter(tuple(r)[:4] for r in coded.collect()) == expected
    back = bpe_rows.decoded(coded, RANKS)
    assert Counter(r["text"] for r in back.collect()) == Counter(t or "" for t in texts)
    assert bpe_rows.encoded(none, RANKS, public_tokenizers.PATTERN).collect() == []
    assert bpe_rows.decoded(coded.limit(0), RANKS).collect() == []


def test_bpe_blocks_change_nothing(monkeypatch):
    tokens, texts = bpe_rows.ranks_of(RANKS), [t or "" for t in texts_to_code()][-60:]
    codec = bpe_rows.Codec(tokens, public_tokenizers.PATTERN, bpe_rows.stand_ins())
    ids = list(codec.encode(texts))
    monkeypatch.setattr(bpe_rows, "DECODE_ROWS", 50)
    monkeypatch.setattr(bpe_rows, "MEMO_WORDS", 3)
    monkeypatch.setattr(bpe_rows, "SLICE_CHARS", 64)
    assert [x.tolist() for x in codec.encode(texts)] == [x.tolist() for x in ids]
    assert bpe_rows._digests(codec, ids) == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def plain_contraction(word, ranks):
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("long_word", [0, 20, 64])
def test_contraction_order_with_rivals(monkeypatch, long_word):
    """Vocabularies in which a merge may form a pair of lower rank than its own, by the query for long words and the other."""
    monkeypatch.setattr(bpe_rows, "LONG_WORD", long_word)
    rng = random.Random(9)
    for _ in range(25):
        longer = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(30)})
        rng.shuffle(longer)
        tokens = [bytes([b]) for b in range(256)] + longer
        codec, ranks = bpe_rows.Codec(tokens, ".+", {}), {t: i for i, t in enumerate(tokens)}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.contract(words)] == [plain_contraction(w, ranks) for w in words]


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (300, 6)) @ rng.normal(0, 1, (6, 6)) / 3
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(base)]
    rows += [(500 + i, rows[5][1]) for i in range(120)] + [(5, rows[5][1]), (None, rows[7][1])]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0, 2.0]), (906, [1e38] + [0.0] * 5)]
    return rows, odd


def whitened_plainly(rows, weights):
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows])
    seen, counts = np.unique(x, axis=0, return_counts=True)
    w = np.ones(len(seen), int) if weights == "one" else counts
    n, total = int(w.sum()), w @ seen
    centred = seen - total / n
    values, vectors = np.linalg.eigh((centred * w[:, None]).T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = ((n * x - total) ** 2).sum(axis=1)
    return n, deviation, (x - total / n) @ vectors[:, :4] / np.sqrt(values[:4]), values[:4] / values.sum()


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    rows, odd = vectors()
    table = spark.createDataFrame([(*r, 1, "n") for r in rows + odd], "vec_id long, embedding array<float>, label int, weight string").repartition(3)
    got = defaultdict(list)
    for r in whitening.whitened(table, weights=weights).collect():
        got[r["vec_id"], r["deviation"]].append(r)
    n, deviation, z, explained = whitened_plainly(rows, weights)
    flips = None
    assert sum(map(len, got.values())) == 4 * len(rows)
    for (i, _), d, values in zip(rows, deviation, z):
        mine = sorted(got[i, int(d)], key=lambda r: r["component"])
        assert {r["component"] for r in mine} == {1, 2, 3, 4} and all(r["n"] == n for r in mine)
        found = np.array([next(r["whitened"] for r in mine if r["component"] == k) for k in (1, 2, 3, 4)])
        flips = np.sign(found * values) if flips is None else flips
        assert np.allclose(found, values * flips, atol=1e-9)
        assert np.allclose([next(r["explained"] for r in mine if r["component"] == k) for k in (1, 2, 3, 4)], explained, rtol=1e-9)
        assert all(0 <= r["identity_error"] < 1e-9 for r in mine)


def test_whitening_of_few_vectors(spark):
    shape = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], shape)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [float("nan")])], shape)).collect() == []
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, -0.5])], shape)).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {
        (i, k, 1, 0, None, 0.0, None) for i in (1, 2) for k in (1, 2)}
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], shape)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and math.isclose(max(r["explained"] for r in line), 1.0)
    # Sums of squares beyond a long are null, not wrapped.
    far = whitening.whitened(spark.createDataFrame([(1, [3e12]), (2, [-3e12]), (3, [1.0])], shape)).collect()
    assert {r["vec_id"]: r["deviation"] for r in far}[1] is None and {r["vec_id"]: r["deviation"] for r in far}[3] is not None


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    """Rows that repeat an id, or have none, lose their own repeated lines and no others; equal rows lose them but for one."""
    rows = [(7, "h1\nh2\nh3\nbody"), (7, "only p\nonly q\nonly r\nonly s"), (1, "h1\nh2\nh3\nfirst"), (None, "n1\nn2\nn3"), (None, "n1\nn2\nn3"), (None, "m1\nm2\nm3\nm4"), (9, "e1\ne2\ne3"), (9, "e1\ne2\ne3")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(
        [(7, "body"), (7, rows[1][1]), (1, rows[2][1]), (None, "n1\nn2\nn3"), (None, ""), (None, "m1\nm2\nm3\nm4"), (9, "e1\ne2\ne3"), (9, "")])
    assert sum(r["n_removed"] for r in out) == 9


def test_language_models_reach_workers_without_the_package(spark, docs):
    """What is broadcast unpickles where this package cannot be imported."""
    import pickle
    import subprocess
    import sys

    known = language.train(docs.select("doc_id", "text", "lang"))
    data = pickle.dumps(known.parts())
    code = "import pickle, sys; assert not [m for m in sys.modules if 'matchloom' in m]; x = pickle.load(sys.stdin.buffer); print(len(x[1]))"
    out = subprocess.run([sys.executable, "-I", "-c", code], input=data, capture_output=True, check=True, cwd="/")
    assert int(out.stdout) == len(known.languages) > 1
    texts = [r[1] for r in odd_rows()]
    assert [list(map(str, x)) for x in language.Identifier.of(pickle.loads(data)).judge(texts)] == [list(map(str, x)) for x in known.judge(texts)]
