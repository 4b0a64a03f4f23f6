"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components.

Documents with equal shingle sets form one class. A sketch of each class is made by rounds of
hashed bin placement (Dahlgaard, Knudsen and Thorup 2017): round i throws every shingle into a
random bin with a value in [i, i + 1); rounds t to 2t - 1 throw all of them into bin i - t, so
that every bin is filled. Each bin keeps its least value; two sets agree in a bin with a
probability of their Jaccard similarity, with the concentration of independent samples.

No step lists all pairs of a bucket of copies, yet no pair that shares a bucket and is similar
enough is lost, unless its ends are joined by other links already:

* Every member of a bucket is compared with the bucket's pivot p, the member that shares most
  buckets (the original of a family of copies, as a rule). That gives the differences D(x) of its
  set from p's, which shows it as linked, near (similarity of 2s - 1 or more) or far.
* Two linked members are joined by p. A linked and a far one can't be similar, since Jaccard
  distance obeys the triangle inequality.
* A near member x and a linked or near one y, with different components: X and Y differ by
  |D(x)| + |D(y)| - 2 |D(x) and D(y)|, so to be similar they must share a least number c > 0 of
  *differences*. By the prefix principle one of the first |D| - c + 1 of them, in order of how many
  members have them, is common to both; a join on those few and rare ones finds all such pairs.
* A far member (a false hit of the bands) may be similar to another unlinked one of its bucket. By
  the same principle such a pair shares one of the first n - ceil(s n) + 1 shingles of either set;
  a join on those finds it, without listing a bucket's pairs.

"Order" above is any one order of all shingles. Rare ones come first by a table of 2^20 hashed
counts, so that no shingle has to be shuffled for being counted. A shingle that only members of
one component have is left out of the joins, however many they are.

A class of equal shingle sets is named by a number of its own, not by an id, so that ids which
repeat with other texts lose nothing. Tables that an aggregate makes are written before they are
joined: Spark can then split a hot key of the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Scratch, Text, bucket_counts, mix, ngrams, quoted, slices, unused

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0xD1342543DE82EF95)
#: Counts of shingles that decide the order of prefixes.
_COUNT_BITS = 20


@dataclass(frozen=True)
class NearDupConfig:
    """Pairs with 100 * |A and B| >= percent * |A or B| are linked. A pair with a similarity of
    0.8 shares none of the ``bands`` bands of ``rows`` bins with a probability of 5e-6."""

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    seed: int = 1


def shingles(t: Text, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and their documents.

    A text with fewer words than n has one shingle, its whole sequence of words; one without
    words has none.
    """
    words, doc = t.words(), t.doc_of_words()
    keys, at = ngrams(words, doc, n)
    doc_of = doc[at]
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < n))
    if len(short):
        whole = np.full(len(short), np.uint64(0x51ED270B))
        for i in range(n - 1):
            has = t.n_words[short] > i
            w = words[np.minimum(t.at[short] + i, len(words) - 1)]
            whole = np.where(has, mix(whole * _STEP + w), whole)
        keys, doc_of = np.concatenate([keys, whole]), np.concatenate([doc_of, short])
    order = np.lexsort((keys, doc_of))
    keys, doc_of = keys[order], doc_of[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (doc_of[1:] != doc_of[:-1])
    return keys[first], doc_of[first]


def sketch(keys: np.ndarray, doc: np.ndarray, n_docs: int, size: int, seed: int) -> np.ndarray:
    """Fast similarity sketches, (n_docs, size); rows of documents without keys stay empty."""
    out = np.full(n_docs * size, _NONE)
    has = np.zeros(n_docs, bool)
    has[doc] = True
    check = 0
    for i in range(2 * size):
        h = mix(keys ^ mix(np.full(1, seed * 4096 + i, np.uint64)))
        value = (np.uint64(i) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
        if i < size:
            where = (((h >> np.uint64(40)) * np.uint64(size)) >> np.uint64(24)).astype(np.int64)
        else:
            where = i - size
        np.minimum.at(out, doc * size + where, value)
        if i == check or i == 2 * size - 1:
            # more rounds than needed change nothing: a later value never beats an earlier one
            check = i + 1 + i // 3
            live = np.zeros(n_docs, bool)
            rows = np.flatnonzero(has)
            live[rows] = (out.reshape(n_docs, size)[rows] == _NONE).any(axis=1)
            has = live
            on = live[doc]
            keys, doc = keys[on], doc[on]
            if not len(keys):
                break
    return out.reshape(n_docs, size)


def bands_of(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per document and band; keys of different bands differ."""
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _STEP, (len(sketches), bands)).copy()
    parts = sketches.reshape(len(sketches), bands, rows)
    for r in range(rows):
        h = mix(h ^ parts[:, :, r]) + _STEP
    return h


def _signatures(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(id, t, n, d1, d2, bands) of each row of (id, t, text); d1 and d2 name the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                t = Text(batch.column(2).slice(a, b - a), lower=True)
                n = b - a
                keys, doc = shingles(t, cfg.shingle)
                count = np.bincount(doc, minlength=n)
                at = np.concatenate([[0], np.cumsum(count)])
                names = []
                for salt in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(keys ^ mix(np.full(1, salt, np.uint64))))])
                    names.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                b_keys = bands_of(sketch(keys, doc, n, cfg.bands * cfg.rows, cfg.seed), cfg.bands, cfg.rows)
                ends = np.cumsum(np.concatenate([[0], np.where(count > 0, cfg.bands, 0)])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(b_keys[count > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(count, pa.int64()), pa.array(names[0]), pa.array(names[1]), lists],
                    names=["id", "t", "n", "d1", "d2", "bands"],
                )

    return docs.mapInArrow(run, "id long, t long, n long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(id, items): the sorted shingle hashes of each row of (id, text), eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                keys, doc = shingles(Text(batch.column(1).slice(a, b - a), lower=True), cfg.shingle)
                at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))])
                raw = keys.astype("<u8").tobytes()
                items = [raw[8 * x : 8 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(items, pa.binary())], names=["id", "items"])

    return docs.mapInArrow(run, "id long, items binary")


def _with_items(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "items_a", "items_b")


def _sorted_pair(x: pa.Scalar, y: pa.Scalar) -> tuple[np.ndarray, np.ndarray, int]:
    p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
    both = np.concatenate([p, q])
    both.sort()
    return p, q, int((both[1:] == both[:-1]).sum())


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b) of (a, b, items_a, items_b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q, common = _sorted_pair(x, y)
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def prefix_length(d: int, n_pivot: int, n: int, against_any: bool, percent: int) -> int:
    """How many of a member's d differences must be looked at.

    Similar enough means |X delta Y| * (100 + s) <= (|X| + |Y|) * (100 - s). Against an unlinked
    y, x shares more than (|D(x)| + k (|P| - |X|)) / 2 differences with it, with
    k = (100 - s) / (100 + s); an unlinked x against any y at least (|D(x)| + (1 - k) - k (|X| + |P|)) / 2.
    """
    den, k = 100 + percent, 100 - percent
    twice = den * d + (den - k - k * (n_pivot + n) if against_any else k * (n_pivot - n))
    return d - max(1, -(-twice // (2 * den))) + 1


def _compared(pairs: DataFrame, percent: int) -> DataFrame:
    """(p, x, d, linked, near, diff, few, most): members x against pivots p; ``diff`` holds the
    differences of near ones, of which the first ``few`` do against unlinked members, ``most`` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, linked, near, diff, few, most = [], [], [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q, common = _sorted_pair(x, y)
                either = len(p) + len(q) - common
                d.append(either - common)
                linked.append(100 * common >= percent * either)
                near.append(100 * common >= (2 * percent - 100) * either)
                if near[-1]:
                    few.append(prefix_length(d[-1], len(p), len(q), False, percent))
                    most.append(few[-1] if linked[-1] else prefix_length(d[-1], len(p), len(q), True, percent))
                    diff.append(np.setxor1d(p, q, assume_unique=True).view(np.int64))
                else:
                    few.append(0)
                    most.append(0)
                    diff.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(d, pa.int64()), pa.array(linked, pa.bool_()), pa.array(near, pa.bool_()), pa.array(diff, pa.list_(pa.int64())), pa.array(few, pa.int64()), pa.array(most, pa.int64())],
                names=["p", "x", "d", "linked", "near", "diff", "few", "most"],
            )

    return pairs.mapInArrow(run, "p long, x long, d long, linked boolean, near boolean, diff array<long>, few long, most long")


def _array(x: pa.Scalar) -> np.ndarray:
    """The shingles of a binary or list value."""
    return np.frombuffer(x.as_buffer(), "<u8") if isinstance(x, pa.BinaryScalar) else x.values.to_numpy(zero_copy_only=False).view(np.uint64)


def _rare_first(rows: DataFrame, values: str, take: str) -> DataFrame:
    """The other columns of ``rows``, with ``e``: the first ``take`` of ``values``, rarest first, and ``at``, its place."""
    shift = np.uint64(64 - _COUNT_BITS)

    def buckets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        if batch.num_rows:
            yield 0, (np.concatenate([_array(x) for x in batch.column(0)]) >> shift).astype(np.int64)

    counts = bucket_counts(rows.select(values), buckets, 1 << _COUNT_BITS)[0]
    often = rows.sparkSession.sparkContext.broadcast(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))  # 4 MB
    carry = [c for c in rows.columns if c not in (values, take)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lengths = [], []
            for x, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                v = _array(x)
                found.append(v[np.lexsort((v, often.value[v >> shift]))[:n]])
                lengths.append(len(found[-1]))
            of = np.repeat(np.arange(batch.num_rows), lengths)
            e = np.concatenate(found) if found else np.zeros(0, np.uint64)
            at = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths) if len(of) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of)) for c in batch.columns[2:]), pa.array(e.view(np.int64)), pa.array(at, pa.int64())], names=[*carry, "e", "at"])

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.select(values, take, *carry).mapInArrow(run, f"{types}, e long, at long")


def components(edges: DataFrame, most_rounds: int = 50, tables: Scratch | None = None) -> DataFrame:
    """(id, component) of the ends of edges (a, b); component is the least id reachable.

    Large-star and small-star rounds (Kiveris et al. 2014): each is a minimum per node and a join,
    and a chain of n nodes takes O(log n) of them. The minima are written before they are joined,
    so that Spark can split the neighbours of one node.
    """
    tables = tables or Scratch(edges.sparkSession)
    pairs = tables.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        # done where each node has one edge down, to a node without any
        ends = pairs.groupBy("u").agg(F.count("*").alias("down")).unionAll(pairs.select(F.col("v").alias("u"), F.lit(0).alias("down")).distinct())
        if ends.groupBy("u").agg(F.sum("down").alias("down"), F.count("*").alias("roles")).where("down > 1 or (down > 0 and roles > 1)").isEmpty():
            break
        both = pairs.union(pairs.select("v", "u"))
        least = tables.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # one row per edge
        large = tables.write(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large", instead_of=(least, pairs))
        least = tables.write(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs = tables.write(small.where("u <> v").distinct(), "edges", instead_of=(least, large))
    else:
        raise RuntimeError("components did not converge")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _labels(edges: DataFrame, tables: Scratch) -> DataFrame:
    own = Scratch(tables.spark)
    label = tables.write(components(edges, tables=own), "label")
    own.clear()
    return label


def _similar_sizes(percent: int):
    return F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent


def _side(df: DataFrame, end: str, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{c}{end}") for c in df.columns if c not in keys))


def _near_pairs(star: DataFrame, known: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """(x1, x2): pairs of members with one pivot, not both linked to it, that differences leave open."""
    open_ = (F.col("c1") != F.col("c2")) & _similar_sizes(percent)
    open_ &= F.abs(F.col("d1") - F.col("d2")) * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent)
    # a pair's first common difference, at1 and at2 in the common order, leaves at most so many to share
    open_ &= F.least(F.col("d1") - F.col("at1"), F.col("d2") - F.col("at2")) * (2 * (100 + percent)) >= (F.col("d1") + F.col("d2")) * (100 + percent) - (
        F.col("n1") + F.col("n2")
    ) * (100 - percent)
    mixed = known.where("near and not linked").select("p").distinct()
    differ = star.where("near").select("p", "x", "diff", "most").join(mixed, "p", "left_semi")
    first = _rare_first(differ, "diff", "most").join(known.select("p", "x", "n", "c", "d", "linked", "few"), ["p", "x"])
    first = tables.write(first, "first")
    free, linked = first.where("not linked").drop("linked"), first.where("linked").drop("linked", "few")
    few = free.where("at < few").drop("few")
    free = free.drop("few")
    one = _side(free, "1", "p", "e").join(_side(linked, "2", "p", "e"), ["p", "e"]).where(open_)
    two = _side(few, "1", "p", "e").join(_side(few, "2", "p", "e"), ["p", "e"]).where(open_ & (F.col("x1") < F.col("x2")))
    return one.select("x1", "x2").union(two.select("x1", "x2"))


def _far_pairs(shared: DataFrame, known: DataFrame, sets: DataFrame, percent: int, tables: Scratch) -> DataFrame | None:
    """(x1, x2): pairs of a bucket's unlinked members, one of them far, that a rare common shingle leaves open."""
    loose = shared.select("band", "p", F.col("rep").alias("x")).join(known.where("not linked").select("p", "x", "n", "c", "near"), ["p", "x"])
    bands = tables.write(loose.groupBy("band").agg(F.count("*").alias("m"), F.bool_and("near").alias("near")).where("m > 1 and not near").select("band"), "far")
    ends = tables.write(loose.join(bands, "band").groupBy("x").agg(F.first("n").alias("n"), F.first("c").alias("c"), (~F.bool_and("near")).alias("far")), "ends", instead_of=(bands,))
    if ends.isEmpty():
        return None
    take = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long") + 1
    rows = ends.join(sets.withColumnRenamed("id", "x"), "x").withColumn("take", take)
    rare = tables.write(_rare_first(rows, "items", "take"), "rare", instead_of=(ends,))
    # shingles of one component only, or of no far member, make no pair
    keys = tables.write(rare.groupBy("e").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("far").alias("far")).where("low < high and far").select("e"), "keys")
    rare = rare.join(keys, "e")
    open_ = (F.col("c1") != F.col("c2")) & _similar_sizes(percent)
    open_ &= F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent
    open_ &= ~F.col("far2") | (F.col("x1") < F.col("x2"))
    return _side(rare.where("far"), "1", "e").join(_side(rare, "2", "e"), "e").where(open_).select("x1", "x2")


def _components(docs: DataFrame, doc_id: str, text: str, cfg: NearDupConfig) -> DataFrame:
    """(id, t, n, component) of each row of ``docs``; ``t`` is the 64-bit hash of the text."""
    tables = Scratch(docs.sparkSession)
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("t"), "text")
    sig = tables.write(_signatures(rows, cfg), "signatures")
    classes = sig.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("least"), F.min_by("t", "id").alias("t"), F.first("n").alias("n"))
    classes = tables.write(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    named = classes.select(F.col("least").alias("id"), "t", "rep")
    members = tables.write(sig.where("n > 0").select("id", "t", "n", "bands").join(named, ["id", "t"]).select("rep", "n", "bands"), "members")
    spread = members.select("rep", "n", F.explode("bands").alias("band"))
    sizes = tables.write(spread.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = tables.write(spread.join(sizes, "band"), "shared", instead_of=(members, sizes))
    popular = shared.groupBy("rep").agg(F.sum("size").alias("popular"))
    pivots = tables.write(shared.join(popular, "rep").groupBy("band").agg(F.max_by("rep", "popular").alias("p")), "pivots")
    shared = tables.write(shared.join(pivots, "band").where("rep <> p").select("band", "rep", "n", "p"), "shared", instead_of=(shared, pivots))
    ids = shared.select(F.explode(F.array("rep", "p")).alias("rep")).distinct()
    wanted = tables.write(ids.join(named, "rep").select("id", "t", "rep"), "wanted")
    # as many as there are classes that share a band, so never broadcast
    texts = rows.join(wanted.hint("merge"), ["id", "t"]).select(F.col("rep").alias("id"), "text").dropDuplicates(["id"])
    sets = tables.write(_sets(texts.select("id", "text"), cfg), "sets", instead_of=(wanted,))
    star = shared.select(F.col("p").alias("a"), F.col("rep").alias("b")).distinct()
    star = tables.write(_compared(_with_items(star, sets), cfg.percent), "star")
    links = star.where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))
    label = _labels(links, tables)
    size = classes.select("rep", "n").join(label.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("rep").alias("x"), "n", F.coalesce("component", "rep").alias("c"))
    known = tables.write(star.drop("diff").join(size, "x"), "known")
    pairs = _near_pairs(star, known, cfg.percent, tables)
    far = _far_pairs(shared, known, sets, cfg.percent, tables)
    pairs = pairs if far is None else pairs.union(far)
    pairs = pairs.select(F.least("x1", "x2").alias("a"), F.greatest("x1", "x2").alias("b")).distinct()
    more = tables.write(_linked(_with_items(pairs, sets), cfg.percent), "links")
    if not more.isEmpty():
        label = _labels(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), tables)
    # the least id of each component, then of each class
    joined = classes.join(label.withColumnRenamed("id", "rep"), "rep")
    first = tables.write(joined.groupBy("component").agg(F.min("least").alias("first")), "firsts")
    found = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").join(first, "component", "left").select("d1", "d2", F.coalesce("first", "least").alias("component"))
    found = tables.write(found, "found")
    tables.keep(sig, found)
    own = sig.select("id", "t", "n", "d1", "d2").join(found, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return own.select("id", "t", "n", component.alias("component"))


def _kept():
    return F.coalesce(F.col("component") == F.col("id"), F.lit(True))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    r"""(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Words are runs of bytes other than ``[\x20\x09-\x0D]``, with A-Z in lower case. Shingles are
    compared by a 64-bit hash. ``component_id`` is the least id that links lead to, ``kept`` is
    whether it is the row's own id. A row without words has no links. Rows with a null id are not
    linked: their component is null and they are kept. Rows that repeat an id get one result each,
    by their own text; a repeated row has the same result again. Very long texts are sketched and
    compared whole. Other columns of ``docs`` are not read. The result reads tables that stay in
    the shared folder. An empty table gives no rows.
    """
    out = _components(docs, doc_id, text, cfg)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), _kept().alias("kept"))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    A row goes by its id and text: of rows that share an id, those with other texts stay, and
    repeated rows stay or go together. Rows with a null id or without words stay. An empty table stays empty.
    """
    tables = Scratch(docs.sparkSession)
    gone = _components(docs, doc_id, text, cfg).where(~_kept()).select("id", "t").distinct()
    i, t = unused("gone_id", docs.columns), unused("gone_text", docs.columns)
    gone = tables.write(gone.select(F.col("id").alias(i), F.col("t").alias(t)), "gone")
    same = (F.col(quoted(doc_id)).cast("long") == F.col(i)) & (F.xxhash64(F.col(quoted(text)).cast("string")) == F.col(t))
    return docs.join(gone, same, "left_anti")
