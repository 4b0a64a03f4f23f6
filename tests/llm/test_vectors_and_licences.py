"""Clusters, vector codes and licence scans against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from floodgrid.llm import bitplanes, licences, vectorcodes

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, code string"


def usable(v):
    return v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)


def nearest(q, c):
    d = ((q[:, None] - c[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def means(q, c, k):
    return np.array([q[c == i].sum(axis=0) // (c == i).sum() if (c == i).any() else old for i, old in enumerate(k)])


def digest(numbers):
    return hashlib.sha256(",".join(str(int(x)) for x in numbers).encode()).hexdigest()


def brute_clusters(rows, k=40, rounds=5, scale=256):
    rows = [r for r in rows if usable(r[1])]
    if not rows:
        return []
    q = np.floor(np.array([r[1] for r in rows], float) * scale).astype(np.int64)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest()))[:k]
    c = q[first]
    for _ in range(rounds):
        c = means(q, nearest(q, c)[0], c)
    own, d = nearest(q, c)
    return [(r[0], int(own[i]), int(d[i]), int(d[own == own[i]].sum()), int(d.sum()), digest(c[own[i]])) for i, r in enumerate(rows)]


def brute_codes(rows, entries=256, rounds=4):
    rows = [r for r in rows if usable(r[1])]
    if not rows:
        return []
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [np.floor(1024 * x) for x in r[1]]))
    q = np.floor(np.array([r[1] for r in rows], float) * 1024).astype(np.int64).reshape(len(rows), 4, 16)
    books, found = [], []
    for p in range(4):
        x = q[:, p]
        book = x[:entries]
        for _ in range(rounds):
            book = means(x, nearest(x, book)[0], book)
        books.append(book)
        found.append(nearest(x, book))
    error = sum(d for _, d in found)
    labels = [r[2] for r in rows]
    by_label = {x: sum(int(e) for e, y in zip(error, labels, strict=True) if y == x) for x in set(labels)}
    said = digest(np.concatenate([b.ravel() for b in books]))
    return [(r[0], "".join(f"{c[i]:02x}" for c, _ in found), int(error[i]), by_label[r[2]], said) for i, r in enumerate(rows)]


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def odd_vectors():
    """Clusters, a third of all rows equal, repeated ids and rows, and rows that don't count."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 64))
    rows = [(i, (centres[i % 12] + rng.normal(size=64) * 0.01).tolist(), i % 5 if i % 7 else None) for i in range(500)]
    rows += [(i, centres[3].tolist(), 1) for i in range(500, 750)]
    rows += [rows[5], rows[5], (None, centres[0].tolist(), None), (-4, [x * 1000 for x in centres[1].tolist()], 2)]
    bad = [float("nan"), float("inf"), -float("inf"), None, 1e30]
    rows += [(900 + i, [0.5] * 63 + [x], 1) for i, x in enumerate(bad)]
    rows += [(910, None, 1), (911, [], 1), (912, [1.0] * 63, 1), (913, [1.0] * 65, 1)]
    return [(*r, "other", "columns") for r in rows]


def test_planes_hold_integers_and_give_dot_products():
    rng = np.random.default_rng(1)
    for most in (0, 1, 7, 300, bitplanes.LIMIT):
        a, b = rng.integers(-most, most + 1, (37, 64)), rng.integers(-most - 5, most + 1, (11, 64))
        pa, pb = (bitplanes.to_planes(x, int(bitplanes.widths(x).max())) for x in (a, b))
        assert (bitplanes.from_planes(pa) == a).all() and (bitplanes.from_planes(pb) == b).all()
        assert (bitplanes.dot_products(pa, pb) == a @ b.T).all()
    assert bitplanes.widths(np.array([[0] * 64, [-1] * 64, [1] * 64, [-128] + [0] * 63, [128] + [0] * 63])).tolist() == [1, 1, 2, 8, 9]


def test_clusters_equal_brute_force(spark, odd_vectors):
    counted = [r for r in odd_vectors if r[1] is None or not any(x == 1e30 for x in r[1])]  # beyond 2^27 no distance fits
    same(bitplanes.plane_kmeans(spark.createDataFrame(odd_vectors, SCHEMA).repartition(5)), brute_clusters(counted))
    few = odd_vectors[:7]
    same(bitplanes.plane_kmeans(spark.createDataFrame(few, SCHEMA), rounds=2), brute_clusters(few, rounds=2))
    assert bitplanes.plane_kmeans(spark.createDataFrame([], SCHEMA)).collect() == []
    assert bitplanes.plane_kmeans(spark.createDataFrame(odd_vectors[-4:], SCHEMA)).collect() == []


def test_ties_go_to_the_smaller_cluster(spark):
    rows = [(i, [0.0] * 64, 0, "", "") for i in range(50)] + [(99, [1.0] * 64, 0, "", "")]
    got = bitplanes.plane_kmeans(spark.createDataFrame(rows, SCHEMA), k=51)
    same(got, brute_clusters(rows, k=51))
    assert len({r["cluster"] for r in got.collect()}) == 2


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = vectorcodes.hilbert_keys(points, bits)
        assert sorted(keys.tolist()) == list(range(1 << (bits * dims)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_shortlists_lose_no_nearest_entry():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.integers(-2000, 2000, (9, 16)), 400, axis=0) + rng.integers(-20, 21, (3600, 16))
    x = np.concatenate([x, np.repeat(x[:1], 200, axis=0)])
    entries = np.concatenate([x[::30], x[:2], x[:2]])
    blocks = vectorcodes.Blocks(vectorcodes._part_of(x), 16)
    short = blocks.shortlists(entries)
    code, error, whole = blocks.assign(entries, distances=True)
    want, least = nearest(x[blocks.rows], entries)
    assert (code == want).all() and (error == least).all() and short[np.arange(len(want)) // vectorcodes.BLOCK, want].all()
    assert short.mean() < 0.5
    n, total = blocks.sums_of(entries)
    assert (n == np.bincount(want, minlength=len(entries))).all() and (total == [x[blocks.rows][want == e].sum(axis=0) for e in range(len(entries))]).all()
    alone = vectorcodes.Blocks(vectorcodes._part_of(np.repeat(x[:1], 130, axis=0)), 16)
    assert alone.assign(x[:1])[2].all() and alone.sums_of(x[:1])[1].tolist() == [(130 * x[0]).tolist()]


def test_codes_equal_brute_force(spark, odd_vectors, monkeypatch):
    counted = [r for r in odd_vectors if r[1] is None or not any(x == 1e30 for x in r[1])]
    same(vectorcodes.vector_codes(spark.createDataFrame(odd_vectors, SCHEMA).repartition(5)), brute_codes(counted))
    few = odd_vectors[:9]
    same(vectorcodes.vector_codes(spark.createDataFrame(few, SCHEMA)), brute_codes(few))
    assert vectorcodes.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        vectorcodes.vector_codes(spark.createDataFrame([], SCHEMA), parts=5)


# licences

SAID = ["Under the MIT License", "under  the\nmit-license", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by", "GNU General Public License, version 3", "all rights reserved", "the MIT", "license"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items():
        own = phrase.split()
        places = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        at += places
        labels |= {label} if places else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places_equal_brute_force(spark, docs, corpus):
    rng = random.Random(8)
    made = [rng.choice([" ", "\n", ". ", " é ", "", "İ K "]).join(rng.choice([*SAID, "word", "Über", "x1"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = [*corpus, *((1000 + i, t) for i, t in enumerate(made)), (5000, "cc by nc " * 20_000), (5001, "license: mit or " * 20_000), (5002, "(" * 10_000)]
    got = licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        r = by[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    ("text", "labels", "weight", "rest"),
    [
        ("mit", "mit", 0.1, ""),
        ("mit or gpl-3.0-only and cc-by-nc-4.0 tail", "mit gpl-3 cc-by-nc", 0.1, " tail"),
        ("(mit or gpl-3.0) and cc-by-nc-4.0", "mit gpl-3 cc-by-nc", 0.9, ""),
        ("gpl-2.0+ with classpath-exception-2.0 and mit", "gpl-2 mit", 0.3, ""),
        ("((mit) or (apache-2.0", "mit apache-2", 0.1, ""),
        ("mit or", "mit", 0.1, " or"),
        ("mit and ( or x", "mit", 0.1, " and ( or x"),
        ("mit) and gpl-3.0", "mit", 0.1, ") and gpl-3.0"),
        ("mit with (x)", "mit", 0.1, " with (x)"),
        ("licenseref-own", "licenseref-own", 0.5, ""),
        ("lgpl-2.1-or-later */", "lgpl-2", 0.45, " */"),
        ("cc-by-nc-sa-4.0\nor mit", "cc-by-nc-sa", 0.9, "\nor mit"),
    ],
)
def test_expressions(text, labels, weight, rest):
    value, end = licences.evaluate(text.encode())
    assert (value.labels, value.weight, text[end:]) == (frozenset(labels.split()), pytest.approx(weight), rest)


def test_no_expression():
    for text in (b"", b"( and", b"or mit", b"*"):
        assert licences.evaluate(text)[0] is None


def test_the_method_s_labels():
    assert licences.scan("Licensed under CC BY-NC-SA 4.0.").labels == "cc-by-nc,cc-by-nc-sa"  # base labels stay
    assert licences.scan("CC BY-SA, GNU GPL v3").labels == "cc-by-sa,gpl-3"
    assert licences.scan("# License: see below. License: MIT").expressions == ["mit"]
    assert licences.scan("# SPDX-License-Identifier: Foo-1.0 OR MIT\nint x;")[5:] == ("foo-1.0,mit", 0.1, ["foo-1.0 or mit"])
    assert licences.scan("permissive words alone")[4:] == ("", "", 0.0, [])
    long = "license: a-" * 30_000 + "-a" * 300_000 + " or ".join(f"l{i}" for i in range(50_000))
    assert licences.scan(long).n_base == 0


def test_licence_scan_edges(odd, none):
    assert licences.licence_scan(none).collect() == []
    rows = licences.licence_scan(odd).collect()
    assert sorted((r["doc_id"] is None, r["n_words"]) for r in rows) == [(False, 0), (False, 0), (False, 6), (False, 6), (True, 0), (True, 6)]


def test_op12_on_the_whole_table(spark):
    from floodgrid.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_license_scans(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(texts[r["doc_id"]])


def test_empty_tables_give_no_rows(spark, none):
    from floodgrid.llm import importance, linededup, media, neardup, packing, pii, repetition, spm, text, tokencount, wrapper

    model, labels = P.path("piece_bpe_32k.model"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ids = spark.createDataFrame([], "doc_id long, ids array<int>")
    results = [
        packing.pack(none, P.path("word_bpe_49k.json")), repetition.repetition(none), importance.importance_resample(none, labels), neardup.near_duplicates(none), neardup.without_near_duplicates(none),
        pii.find_pii(none), pii.redact_pii(none), pii.span_digests(none), linededup.line_dedup(none), tokencount.token_counts(none, model, text.scratch(spark, "none")), spm.encode(none, model), spm.decode(ids, model),
        wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ]
    assert [df.count() for df in results] == [0] * len(results)
    path = text.scratch(spark, "no-media")
    media.store_texts(none, path)
    assert media.media_features(spark, path).count() == 0
