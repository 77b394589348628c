"""Every query that has SQL gives the same rows in DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

from pulsegrid.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else round(x, 4) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert Counter(tuple(map(plain, r)) for r in got.collect()) == Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_amplitude_events_of_a_recording_of_more_samples_than_seconds_in_an_int(spark, tmp_path):
    """Place 2,148 lies beyond 2**31 microseconds."""
    con, path = duckdb.connect(), str(tmp_path / "events.parquet")
    con.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, 7::BIGINT AS user_id, CASE WHEN i % 40 = 0 THEN 'error' ELSE 'view' END AS event_type,
        (i * 37 % 101)::DOUBLE AS value FROM range(2600) r(i)) TO '{path}' (FORMAT parquet)""")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    want = con.sql(ORACLES["chunked_amplitude_events"]).fetchall()
    assert max(t for _, t in want) > 2**31
    assert sorted(map(tuple, QUERIES["chunked_amplitude_events"](spark, str(tmp_path)).select("rec_id", "t").collect())) == sorted(want)
