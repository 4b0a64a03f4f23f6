import random
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(tuple(r[c] for c in pipeline.COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empties, a long text, repeated rows and ids, an extra column whose name clashes."""
    rng = random.Random(4)
    words = lambda n: " ".join(f"word{rng.randrange(500)}" for _ in range(n))
    base, other = words(80), words(60)
    rows = [(1, base, "en", "s", 1), (1, base, "en", "s", 1), (2, f"{base} end", "en", None, 2), (2, other, None, "s", 3), (3, f"{other} more", "en", "s", 4)]
    rows += [(None, base, "en", "s", 5), (4, None, None, None, None), (5, "", "en", "s", 0), (6, "mail me: a.b@c.org\nsame line", "en", "s", 6), (7, words(30_000), "en", "s", 7)]
    rows += [(10 + i, f"{words(30)}\n Same LINE \n{words(5)}", "en", "s", 8) for i in range(12)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars int, kept string")


def test_stages_handle_odd_rows(spark, odd):
    stages = dict(pipeline.STAGES)
    given = rows_of(odd)
    out = stages["quality classifier"](spark, odd, SF)
    assert out.columns == pipeline.COLUMNS and not rows_of(out) - given
    out = stages["line dedup"](spark, odd, SF)
    assert out.columns == pipeline.COLUMNS and out.count() == odd.count()
    got = {r["doc_id"]: r["text"] for r in out.where("doc_id > 3").collect()}
    assert got[4] is None and got[5] == "" and got[6] == "mail me: a.b@c.org" and all("ame" not in got[10 + i] and got[10 + i].count("\n") == 1 for i in range(12))
    assert out.where("char_length(text) <> n_chars").isEmpty()
    out = stages["near dedup"](spark, odd, SF)
    gone = given - rows_of(out)
    assert out.columns == pipeline.COLUMNS and not rows_of(out) - given
    assert sorted((i, t.split()[-1]) for i, t, *_ in gone.elements()) == [(2, "end"), (3, "more")]
    out = stages["pii"](spark, odd, SF)
    assert out.columns == pipeline.COLUMNS and {r["text"] for r in out.where("doc_id = 6").collect()} == {"mail me: <email>\nsame line"}
    assert out.count() == odd.count()
    out = stages["packing"](spark, odd, SF)
    ends = Counter(r["doc_id"] for r in out.collect() if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == Counter(r["doc_id"] for r in odd.collect())


def test_stages_handle_empty_tables(spark, odd):
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF).cache()
        assert out.columns == pipeline.COLUMNS and out.count() <= seen[-1].count()
        assert out.where("char_length(text) <> n_chars").isEmpty() or len(seen) == 1
        seen.append(out)
    kept = {r["doc_id"] for r in seen[1].select("doc_id").collect()}
    bad = [i for i, r in labels.items() if r["quality"] == 0]
    good = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in kept for i in bad) <= 0.2 * len(bad) and sum(i in kept for i in good) >= 0.9 * len(good)
    pieces = pipeline.STAGES[-1][1](spark, seen[-1], SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in seen[-1].select("doc_id").collect()}


def test_pipeline_runs_whole(spark):
    assert pipeline.run(spark, SF).count() > 0
