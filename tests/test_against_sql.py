"""Queries on small odd tables, compared with their own SQL, signs of zeros included."""

import random

import pytest

from floodgrid.operators import hydro as H


@pytest.fixture
def both(spark, tmp_path):
    """Writes a table from SQL, and gives a query's rows by Spark and by its SQL, as text."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()

    def run(name, table, rows):
        path = tmp_path / f"{table}.parquet"
        con.execute(f"COPY ({rows}) TO '{path}'")
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{path}'")
        said = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in said.description]
        wanted = sorted(repr(list(r)) for r in said.fetchall())
        return sorted(repr([r[n] for n in names]) for r in entry.queries()[name](spark, str(tmp_path)).collect()), wanted

    return run


FLOWS = [
    (1, 2, 7.0), (1, 5, 9.0), (1, 30, 9.0), (1, 60, 9.0), (1, 90, 3.0),  # three times of one peak
    (2, 3, float("nan")), (2, 8, float("nan")), (2, 9, 1e9), (2, 70, 0.0),  # what is not a number is the largest
    (3, 4, None), (3, 6, None), (3, 50, None),
    (4, None, 99.0), (4, 10, 5.0), (4, 20, 5.0), (4, 80, None),
    (5, 11, 0.0), (5, 13, -0.0), (5, 77, -1.0),
    (None, 1, 2.0), (None, 40, 2.0), (6, None, None),
]


def test_simulation_end_takes_the_first_time_of_the_peak(both):
    """Rows lie in order of time, so that DuckDB's arg_max meets a peak's first time first."""
    hour = lambda h: "NULL::TIMESTAMP" if h is None else f"TIMESTAMP '2024-01-01' + INTERVAL {h} HOUR"
    rows = ", ".join(f"({'NULL' if k is None else k}::BIGINT, {hour(h)}, {'NULL' if v is None else repr(str(v))}::DOUBLE, 'a')" for k, h, v in sorted(FLOWS, key=lambda r: (r[1] is None, r[1] or 0)))
    got, wanted = both("a29_simulation_end", "events", f"SELECT * FROM (VALUES {rows}) t(user_id, ts, value, event_type)")
    assert got == wanted
    assert "[1, '2024-01-02 05:00']" in got and "[4, '2024-01-02 10:00']" in got and "[6, None]" in got


@pytest.mark.parametrize("seed", range(3))
def test_peak_time_depends_on_no_order_of_rows(spark, seed):
    rows = random.Random(seed).sample(FLOWS, len(FLOWS))
    flows = spark.createDataFrame(rows, "k int, h int, flow double").repartition(seed + 1).selectExpr("k", "timestamp_seconds(h * 3600) AS ts", "flow")
    got = {r["k"]: r["h"] for r in H.peak_time(flows, ["k"]).selectExpr("k", "unix_seconds(ts) DIV 3600 AS h").collect()}
    assert got == {1: 5, 2: 3, 3: None, 4: 10, 5: 11, 6: None, None: 1}


def test_padded_patches_keep_the_sign_of_what_rounds_to_zero(both):
    values = ["'-1e-7'", "'1e-7'", "'-0.0'", "'0'", "NULL", "'nan'", "'-inf'", "'-0.0078125'", "'0.0078125'", "'-5e-7'", "'-4e-7'", "'123456.789'"]
    rows = [values[i:] + ["'-0.3'"] * 52 + values[:i] for i in range(12)]
    got, wanted = both("r3_pad_patches", "embeddings", " UNION ALL ".join(f"SELECT {i}::BIGINT AS vec_id, [{', '.join(r)}]::FLOAT[] AS embedding, 1 AS label" for i, r in enumerate(rows)))
    assert got == wanted
    assert len(got) == 12 and any("[-0.0, 0.0, -0.0, 0.0, None, nan, -inf, -0.007813, None, None, 0.007813, -0.0, -0.0" in r for r in got)


def test_assembled_samples_keep_the_sign_of_what_rounds_to_zero(both):
    """A depth just below the mean gives -0.0, one just above it 0.0; patch 31's prediction is its target."""
    near = ["'0.0201335'", "'0.0201337'", "'-0.1'", "'-0.0'", "'nan'", "'0.5'"]
    rows = ", ".join(f"({i}::BIGINT, [{', '.join((near * 12)[i % 6 : i % 6 + 64])}]::FLOAT[], {i % 3})" for i in (0, 1, 10, 31, 52, 399))
    got, wanted = both("r22_assemble_samples", "embeddings", f"SELECT * FROM (VALUES {rows}) t(vec_id, embedding, label)")
    assert got == wanted
    assert len(got) == 4 and any(r.startswith("[31, [0.0, -0.5, -0.5, nan,") and "-0.0" in r for r in got)
