"""The corpus operators on small tables: plain loops beside them, and rows of every odd kind."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from matchloom.llm import decontaminate, exact_dedup, language, licenses, line_dedup, mixing, near_copies, simhash, substring, token_planes, url_filter
from matchloom.plans.durable import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, keep_id long, skey string, node long, marks string"
VOCABULARY = [a + b for a in "ka lo mi nu re".split() for b in "stan berg dor fil hom pax".split()]


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty, blank and long texts, equal texts, repeated rows, near copies, shared passages."""
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 60)
    near = base.split()
    near[50] = "changed"
    rows = [
        (1, base, "en", "b"), (2, base, "en", "b"), (3, base, None, None), (4, " ".join(near), "en", "a"), (5, None, "en", "a"), (6, "", "de", "a"),
        (7, " \n\t ", "de", None), (8, "word", "de", "c"), (9, f"{words(rng, 40)} {passage} {words(rng, 30)}", "fr", "a"),
        (10, f"{words(rng, 10)} {passage} {words(rng, 50)}", "fr", "a"), (11, words(rng, 30_000), "en", "b"), (12, "12 34 !!", None, "a"), (None, base, "en", "a"),
        (None, None, None, None), (2, base, "en", "b"), (13, "a\nb\nc\nd\na\nb\nc\nx", "en", "a"), (14, "z\na\nb\nc\nd", "en", "a"), (15, "a\n\n\n\n\nb", "en", "a"),
        (16, "  two  spaces and\r\nmore <|endoftext|> é", "fr", "d"),
    ]
    rows += [(100 + i, words(rng, 20 + i), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for i in range(20)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0 if r[1] is None else len(r[1]), "x", 1, "y", 2, "z") for r in odd_rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_empty_tables(spark, none):
    for out in (
        exact_dedup.exact_dedup(none), simhash.near_duplicates(none), language.identify(none), substring.substring_dedup(none), licenses.license_spans(none),
        mixing.mix(none), line_dedup.line_dedup(none), url_filter.url_filter(none.selectExpr("doc_id page_id", "text url")),
        decontaminate.contaminated(none, none.selectExpr("doc_id item_id", "text")),
    ):
        assert out.count() == 0
    path = fresh_path(spark, "t")
    token_planes.write_tokens(none, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_planes.read_tokens(spark, path).count() == 0


def test_exact_dedup(docs):
    classes = defaultdict(list)
    for i, text, *_ in odd_rows():
        classes[text or ""].append(i)
    want = []
    for i, text, *_ in odd_rows():
        ids = classes[text or ""]
        top = max((x for x in ids if x is not None), default=None)
        want.append((i, top, len(ids), i == top, hashlib.sha256((text or "").encode()).hexdigest()))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert as_rows(exact_dedup.exact_dedup(docs), *columns) == sorted(want, key=repr)
    weak = exact_dedup.text_classes(docs, digest=exact_dedup.F.lit(1))  # all digests collide: texts still decide
    assert weak.count() == len(classes)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_planes(spark, docs, kind):
    path = fresh_path(spark, "t")
    token_planes.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), kind=kind, block_ids=1000)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, text in sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids), ids))
        start += len(ids) // 4
    got = as_rows(token_planes.read_tokens(spark, path), "doc_id", "start", "n_tokens", "ids_crc32", "ids")
    assert [(*g[:4], bytes(g[4])) for g in got] == sorted(want, key=repr)
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert sum(r["n"] for r in index) == start and all(a["start"] + a["n"] == b["start"] for a, b in zip(index, index[1:]))


def plain_components(prints, near):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if near(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_simhash(docs):
    def print_of(text):
        w = [x.lower() for x in split(text)]
        shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(i, print_of(text)) for i, text, *_ in odd_rows()]
    roots = plain_components({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {r: min((i for i, p in prints if roots[p] == r and i is not None), default=None) for r in roots.values()}
    want = sorted(((i, f"{p:016x}", least[roots[p]]) for i, p in prints), key=repr)
    assert as_rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert as_rows(simhash.near_duplicates(docs, cell_rows=2), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("distance,second,cell_rows", [(4, None, 1024), (4, None, 3), (9, 12, 5), (12, None, 8)])
def test_simhash_links_random_fingerprints(spark, distance, second, cell_rows):
    rng, prints = random.Random(distance), {}
    for _ in range(40):
        centre, other = rng.getrandbits(64), rng.getrandbits(64)
        for _ in range(8):
            flip = sum(1 << b for b in rng.sample(range(64), rng.randrange(distance + 2)))
            prints[len(prints)] = (centre ^ flip, other ^ (1 << rng.randrange(64)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(n, signed(a), signed(b)) for n, (a, b) in prints.items()], "node long, fp long, fp2 long")

    def near(a, b):
        d = (prints[a][0] ^ prints[b][0]).bit_count()
        return d <= distance and (second is None or d + (prints[a][1] ^ prints[b][1]).bit_count() <= second)

    links = [(r.u, r.v) for r in simhash.link(frame, distance, second, cell_rows).collect()]
    assert all(near(u, v) for u, v in links)
    assert plain_components(list(prints), near) == plain_components(list(prints), lambda a, b: (a, b) in both) if (both := set(links) | {(v, u) for u, v in links}) else True


def test_language(docs):
    rows = {(r.doc_id, r.lang_pred, r.held_out) for r in language.identify(docs).collect()}
    und = {i for i, said, _ in rows if said == "und"}
    assert und == {5, 6, 7, 12, None}
    assert all(h == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2) for i, _, h in rows)
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and {5, 6, 7, 12}.isdisjoint({r.doc_id for r in kept.collect()})


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(table).filter("held_out").join(table.select("doc_id", "lang"), "doc_id")
    assert out.filter("lang = lang_pred").count() >= 0.97 * out.count()
    assert out.filter("score < 0 OR score > 1 OR rejected").count() <= 0.01 * out.count()


def test_language_model_sums_to_one():
    import pandas as pd

    codes, first, kept = language.stream(["the cat sat on the mat", "then that hat"])
    number, columns = language.distinct(codes, language.scored_places(first, kept))
    frame = pd.DataFrame({f"c{i}": c for i, c in enumerate(columns)} | {"n": np.bincount(number)})
    model = language.fit(frame)
    letters = np.append(np.unique(codes), ord("q"))  # one letter stands for all unknown ones
    for context in ("  t", "the", "xyz"):
        tries = [np.full(len(letters), ord(c), np.uint32) for c in context] + [letters.astype(np.uint32)]
        assert np.exp(-language.surprise(model, tries)).sum() == pytest.approx(1, abs=1e-6)


def test_substring_dedup(docs):
    rows = odd_rows()
    first = {}
    for i, text, *_ in rows:
        w = split(text)
        for p in range(len(w) - 12) if i is not None else ():
            key = tuple(w[p:p + 13])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, text, *_ in rows:
        w = split(text)
        gone = {q for p in range(len(w) - 12) if i is not None and first[tuple(w[p:p + 13])] < i for q in range(p, p + 13)}
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert as_rows(substring.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_substring_dedup_random(spark):
    rng = random.Random(9)
    parts = [words(rng, rng.randrange(5, 40)) for _ in range(12)] + ["a " * 40, "a b " * 20]
    table = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    first = {}
    for i, text in table:
        w = text.split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p:p + 13]), i)
    want = []
    for i, text in table:
        w = text.split()
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p:p + 13])] < i for q in range(p, p + 13)}
        want.append((i, " ".join(x for q, x in enumerate(w) if q not in gone)))
    got = substring.substring_dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, bytes(r.kept).decode()) for r in got if r.kept is not None) == [x for x in want if x[0] in {r.doc_id for r in got if r.kept is not None}]
    assert sorted((r.doc_id, r.kept_sha256) for r in got) == [(i, hashlib.sha256(x.encode()).hexdigest()) for i, x in want]


def test_substring_hash_collision_starts_again(spark, monkeypatch):
    table = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(20))) for i in range(2)], "doc_id long, text string")
    seeds, real = [], substring._attempt
    monkeypatch.setattr(substring, "_attempt", lambda rows, w, a, seed, t: (seeds.append(seed), (real(rows, w, a, seed, t)[0], seed > 0))[1])
    assert substring.substring_dedup(table).filter("doc_id = 1").first().n_removed == 20 and seeds == [0, 2]


def test_licenses(spark, docs):
    rng = random.Random(3)
    mit, apache = licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache-2.0"]
    changed = " ".join(w for k, w in enumerate(mit.split()) if k % 9)
    table = spark.createDataFrame(
        [(1, f"{words(rng, 50)} {mit} {words(rng, 40)} {mit.upper()}"), (2, f"{changed} {words(rng, 10)}"), (3, apache + " Released under the MIT License."), (4, words(rng, 400)), (5, None), (6, ""), (None, apache)],
        "doc_id long, text string",
    )
    got = sorted(((r.doc_id, r.license, r.coverage) for r in licenses.license_spans(table).collect()), key=repr)
    assert [(i, k) for i, k, _ in got] == [(1, "mit"), (1, "mit"), (2, "mit"), (3, "apache-2.0"), (3, "mit-line"), (None, "apache-2.0")]
    assert all(c >= 0.85 for *_, c in got)
    assert licenses.license_spans(docs).count() == 0


def test_patience_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    whole = licenses.words_of(licenses.TEMPLATES["mit"])
    assert len(licenses.patience(whole, ["x", *whole, "y"])) == len(whole)


def test_license_seeds_lose_no_match():
    """Every place of a document tried, against places lined up by seeds."""
    rng = random.Random(2)
    template = licenses.Template("t", licenses.TEMPLATES["isc"], 0.8)
    for trial in range(40):
        body = [w for w in template.words if rng.random() > 0.25]
        document = words(rng, 15).split() + body + words(rng, 15).split()
        n = len(template.words)
        best = max(len(licenses.patience(template.words, document[max(0, p - template.slack):p + n + template.slack])) for p in range(len(document)))
        assert bool(licenses.find(document, template, 0.8)) == (best >= 0.8 * n)


def test_mixing(docs):
    rows = mixing.mix(docs, rank_rows=2).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda rs: sorted(((r.doc_id, r.size, r.source_size, r.target, r.copies, r.taken) for r in rs), key=repr)
    assert key(rows) == key(again)
    sizes, by = defaultdict(int), defaultdict(list)
    for i, text, _, source, *_ in odd_rows():
        sizes[(source is None, source or "")] += len(split(text))
    order = sorted(sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    open_, total, target = set(order), sum(sizes.values()), {}
    while True:  # share, stop at three times the size, share the excess again
        level = (total - sum(3 * sizes[s] for s in order if s not in open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            break
        open_ -= full
    target = {s: level * weight[s] if s in open_ else 3.0 * sizes[s] for s in order}
    for r in rows:
        by[(r.source_size, round(r.target, 6))].append(r)
        assert r.taken <= 3 * r.size
    assert {k for k in by} == {(sizes[s], round(target[s], 6)) for s in order}
    for (_, wanted), rs in by.items():
        assert abs(sum(r.taken for r in rs) - wanted) <= max(r.size for r in rs)


def test_line_dedup(docs):
    rows = odd_rows()
    seen, want = {}, []
    for i, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n")
        for p in range(len(lines) - 2):
            seen.setdefault(tuple(lines[p:p + 3]), (i, p))
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = {q for p in range(len(lines) - 2) if seen[tuple(lines[p:p + 3])] != (i, p) for q in (p, p + 1, p + 2)}
        want.append((i, "\n".join(x for q, x in enumerate(lines) if q not in gone), len(lines), len(gone)))
    assert as_rows(line_dedup.line_dedup(docs), "doc_id", "text", "n_lines", "n_removed") == sorted(want, key=repr)


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "https://WWW.Example.com/en/a?x=1#y", "http://example.com/en/1", "http://a.example.com/en", "http://b.com/fr/2", "http://c.net/es/3",
        "http://d.net/fr/4", "http://e.net/de/5", "http://org?u=://x.net/es/", "http://f.org/" + "a/" * 20_000, "ftp://xcom/", "http://g.com", "http://g.com#/en/",
    ]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate([*urls, *urls])], "page_id long, url string, host string")
    for r in url_filter.url_filter(pages).collect():
        url = ([*urls, *urls])[r.page_id] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        host = rest[:min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])]
        path = rest[len(host):]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), h + p, k) for k, h, p in url_filter.RULES if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host.lower(), path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_url_trees_learn_labels(spark):
    rng = random.Random(4)
    good = [f"http://site{rng.randrange(999)}.org/news/{words(rng, 1)}" for _ in range(400)]
    bad = [f"http://x{rng.randrange(10**9)}.info/p?a={rng.randrange(10**9)}&b={rng.randrange(10**9)}" for _ in range(400)]
    labelled = spark.createDataFrame([(u, "allow") for u in good[::2]] + [(u, "block") for u in bad[::2]], "url string, verdict string")
    pages = spark.createDataFrame(list(enumerate(good[1::2] + bad[1::2])), "page_id long, url string")
    out = url_filter.url_filter(pages, labelled=labelled, rules=()).collect()
    assert sum((r.verdict == "block") == (r.page_id >= 200) for r in out) >= 0.97 * len(out)


def substring_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != c))
        best = min(best, row[-1])
    return best


def test_myers_distance():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (12, 25))
        assert decontaminate.myers(decontaminate.letter_masks(a), len(a), b)[0] == substring_distance(a, b)


@pytest.mark.parametrize("block_chars", [1_000_000, 300])
def test_decontamination(spark, docs, block_chars):
    rng = random.Random(7)
    items = [(k, words(rng, 25 + k)) for k in range(4)] + [(9, "short one"), (10, None), (11, ""), (None, words(rng, 20)), (1, words(rng, 30))]

    def spoiled(text, n):
        letters = list(text)
        for p in rng.sample(range(len(letters)), n):
            letters[p] = rng.choice(["", "zz", "Q"])
        return "".join(letters)

    table = [(k, f"{words(rng, 30)} \n{spoiled(items[k % 4][1], k)}  {words(rng, 20)}".title()) for k in range(16)]
    table += [(90, "Short  ONE"), (91, "not a short one"), (92, None), (93, ""), (94, words(rng, 3000)), (None, items[0][1])]
    documents = spark.createDataFrame([(*r, 0, "q") for r in table], "doc_id long, text string, item_id long, distance string")
    benchmark = spark.createDataFrame([(*r, "q") for r in items], "item_id long, text string, doc_id string")
    want = []
    for i, text in table:
        for k, item in items:
            if text and item and k is not None:
                a, b = decontaminate.normal(item), decontaminate.normal(text)
                d = substring_distance(a, b) if len(a) >= 20 else (0 if a == b else 99)
                if d <= (len(a) * 0.05 // 1 if len(a) >= 20 else 0):
                    want.append((i, k, d))
    got = as_rows(decontaminate.contaminated(documents, benchmark, block_chars=block_chars), "doc_id", "item_id", "distance")
    assert got == sorted(want, key=repr) and len(want) > 5
    kept = {r.doc_id for r in decontaminate.clean(documents, benchmark, block_chars=block_chars).collect()}
    assert kept == {i for i, _ in table} - {i for i, *_ in want}


def test_pipeline_stages(spark, docs, none, tmp_path):
    rng = random.Random(8)
    spark.createDataFrame([(1, words(rng, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, none):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            before = now
            path = fresh_path(spark, name)
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.parquet(path)
            if name != "token_files":
                assert now.columns == before.columns
            if name == "near_dedup" and table is docs:
                ids = [r.doc_id for r in now.collect()]
                assert 1 in ids and not {2, 3, 4} & set(ids) and {8, 9, 10, 11, 13, 14} <= set(ids)
        assert now.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert (now.count() > 0) == (table is docs)


def test_radius_stands_for_similarity():
    assert simhash.radius(0.8) == {"distance": 12, "second": 21}


def brute_groups(table, similarity=0.8):
    """Rows (id, text) by number, in components of all pairs of rows near enough."""
    def shingles(text):
        w = [x.lower() for x in split(text)]
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(text) for _, text in table]
    return plain_components(range(len(table)), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))


def near_the_limit():
    """Groups of a text and changed copies, similar to it between 0.6 and 1, many of them just above and below 0.8."""
    rng, table = random.Random(11), []
    for group in range(60):
        base = words(rng, 205).split()
        table.append((len(table), " ".join(base)))
        for spots in (1, 3, 4, 5, 6, 9):
            near = list(base)
            for p in rng.sample(range(10, 195, 6), spots):
                near[p] = f"new{group}-{p}-{spots}"
            table.append((len(table), " ".join(near)))
    rng.shuffle(table)
    return table


@pytest.mark.parametrize("plan", [{}, {"star_rounds": 0}, {"star_rounds": 0, "few": 1, "block_rows": 2}, {"star_rounds": 1, "few": 2, "block_hashes": 300}])
def test_near_dedup_is_jaccard_of_shingles(spark, plan):
    table = near_the_limit()
    roots = brute_groups(table)
    want = {min(table[k][0] for k in roots if roots[k] == r) for r in set(roots.values())}
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = [r.doc_id for r in near_copies.one_of_each(docs, **plan).collect()]
    assert 60 < len(want) < 360 and sorted(got) == sorted(want)


def test_near_copies_of_a_crowd_in_cells(spark):
    """One crowd of copies changed more and more, most of them below the limit, and a forest no larger than its members."""
    rng = random.Random(15)
    base = words(rng, 120).split(" ")
    table = [(k, " ".join(w if rng.random() > (k % 12) / 60 else f"w{rng.random()}" for w in base)) for k in range(150)]
    roots = brute_groups(table)
    want = {min(table[k][0] for k in roots if roots[k] == r) for r in set(roots.values())}
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert 5 < len(want) < 145
    for plan in ({}, {"few": 1, "block_rows": 20}):
        assert sorted(r.doc_id for r in near_copies.one_of_each(docs, **plan).collect()) == sorted(want)
    sets = [(k, near_copies.shingle_set(text.encode(), 5).view("int64").tolist()) for k, text in table]
    crowds = [(7, k, k, 150, sum(len(s) for _, s in sets)) for k, _ in table]
    links = near_copies.cell_links(
        spark.createDataFrame(crowds, "key long, node long, root long, n long, hashes long"), spark.createDataFrame(sets, "node long, shingles array<bigint>"), 0.8, 1024, 1 << 20,
    ).collect()
    assert len(links) == 150 - len(want)


def test_sketches_keep_near_copies():
    """Of sets with similarities of 0.8 and more none is sifted out, and nearly all pairs of 0.4 are."""
    rng = np.random.default_rng(16)
    differing = lambda a, b: sum(int(x >> np.uint64(4 * k) & np.uint64(15)) != 0 for x in near_copies.sketch(a) ^ near_copies.sketch(b) for k in range(15))
    most = int(120 * (1 - 0.65) * 15 / 16)
    passed = {}
    for shared in (160, 80):
        pairs = [rng.integers(0, 1 << 63, 200 + 200 - shared, np.uint64) for _ in range(60)]
        least = near_copies.least_values
        passed[shared] = sum(differing(least(p[:200]), least(p[200 - shared:])) <= most for p in pairs)
    assert passed[80] == 0
    assert all(differing(near_copies.least_values(p), near_copies.least_values(p[22:])) <= most for p in (rng.integers(0, 1 << 63, 110, np.uint64) for _ in range(60)))


def test_pipeline_stages_with_clashing_columns(spark):
    """Columns named like working columns come through unchanged."""
    rng = random.Random(17)
    names = ["_row", "_copy", "_copies", "copies", "_node", "_size", "_keys", "_sketch", "_word", "c0", "n"]
    rows = [(k, words(rng, 30), "en", "ab"[k % 2], 1, *(f"{n}{k}" for n in names)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.source_mix):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= set(rows)
    assert near_copies.one_of_each(docs).count() == 20


def test_token_files_stage_holds_every_row(spark):
    """The last stage against the tokenizers library: starts, counts and checksums of all rows, repeated ids included."""
    rng = random.Random(18)
    rows = [(k // 2, words(rng, k) if k % 9 else None) for k in range(60)]
    got = corpus_pipeline.token_files(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((k, len(ids(text)), zlib.crc32(ids(text).tobytes())) for k, text in rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(k for k, _ in rows)


def test_source_mix_deals_every_row_its_own_copies(spark):
    """Copies of each row against a plain loop; ids repeat, with one size or several, and many are null."""
    rng, rows = random.Random(12), []
    for k in range(240):
        ident = rng.choice([None, None, k, k % 17, 3])
        rows.append((ident, f"text{k} " + words(rng, rng.choice([1, 4, 4, 9, 30])), rng.choice(["a", "a", "a", "a", "b", "c", None])))
    rows += [(3, "equal rows of one id", "b")] * 5 + [(None, "equal rows without one", "c")] * 4 + [(7, "", "a"), (8, None, "a")]
    by, sizes = defaultdict(list), defaultdict(int)
    for ident, text, source in rows:
        by[(source is None, source or "")].append((len(split(text)), hashlib.md5(str("" if ident is None else ident).encode()).hexdigest(), ident is not None, ident or 0))
        sizes[(source is None, source or "")] += len(split(text))
    order, total = sorted(sizes), sum(sizes.values())
    weight, open_, level = {s: k % 3 + 1 for k, s in enumerate(order)}, set(order), 0
    while full := {s for s in open_ if (level := (total - sum(3 * sizes[s] for s in order if s not in open_)) / sum(weight[t] for t in open_)) * weight[s] > 3 * sizes[s]}:
        open_ -= full
    want = defaultdict(list)  # (source, size, id): copies of its rows, in any order
    for s in order:
        rate = round(min(3.0, (level * weight[s] if s in open_ else 3.0 * sizes[s]) / sizes[s]), 9)
        for place, (size, _, named, ident) in enumerate(sorted(by[s]), 1):
            want[s, size, ident if named else None].append(int(rate * place + 0.5) - int(rate * (place - 1) + 0.5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out, got = defaultdict(int), defaultdict(list)
    for r in corpus_pipeline.source_mix(spark, docs, "").collect():
        out[r.doc_id, r.text, r.source] += 1
    for ident, text, source in set(rows):
        got[(source is None, source or ""), len(split(text)), ident].append((out[ident, text, source], rows.count((ident, text, source))))
    for key, copies in want.items():
        assert sum(n for n, _ in got[key]) == sum(copies)
        if all(times == 1 for _, times in got[key]):
            assert sorted(n for n, _ in got[key]) == sorted(copies)
    assert sum(len(c) > 1 for c in want.values()) > 10 and max(len(c) for c in want.values()) > 5


def test_near_dedup_judges_every_row(spark):
    """Rows without an id and rows of one id: near copies go, other texts stay, and one row of each group stays."""
    rng = random.Random(13)
    text = [words(rng, 80) for _ in range(9)]
    near = lambda k: text[k] + " more"
    table = [
        (1, text[0]), (None, near(0)), (None, text[1]), (None, text[2]), (None, text[2]), (None, near(2)), (2, text[3]), (2, text[4]), (3, text[5]), (3, near(3)),
        (4, text[6]), (4, text[6]), (4, text[6]), (5, text[7]), (5, near(7)), (None, None), (None, ""), (9, text[8]), (9, text[8]), (None, text[8]),
    ]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(table, "doc_id long, text string").repartition(3), "").collect()]
    roots = brute_groups(table)
    for root in set(roots.values()):
        group = [table[k] for k in roots if roots[k] == root]
        kept = [r for r in got if r in group]
        assert len(kept) == 1 and kept[0][0] == min((i for i, _ in group if i is not None), default=None)
    assert len(got) == len(set(roots.values()))


def test_url_suffix_rates_count_all_labelled(spark):
    """A suffix too rare for the fit's sample still has its rate; the sample alone decides nothing about it."""
    rng = random.Random(14)
    urls = [(f"http://s{k}.{'good' if k % 2 else 'bad'}/{words(rng, 1)}", "allow" if k % 2 else "block") for k in range(3000)]
    urls += [(f"http://s{k}.rare/{words(rng, 1)}", "block") for k in range(8)]
    labelled = spark.createDataFrame(urls, "url string, verdict string")
    seen, real = [], url_filter.suffix_rates
    url_filter.suffix_rates = lambda known: seen.append(real(known)) or seen[-1]
    try:
        pages = spark.createDataFrame([(1, "http://other.rare/x")], "page_id long, url string")
        assert url_filter.url_filter(pages, labelled=labelled, rules=(), max_train=300).count() == 1
    finally:
        url_filter.suffix_rates = real
    rates = {r.suffix: r.suffix_rate for r in seen[0].collect()}
    assert rates == {"good": pytest.approx(1 / 1502), "bad": pytest.approx(1501 / 1502), "rare": 0.9}
