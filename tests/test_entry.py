"""The driver's contract."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["hits", "net_crossings", "traj_params", "landing", "player_select", "court_player_select", "drop_verdict", "api_document", "callback_body", "draw_commands", "court_lines", "alternation_fix", "rescue", "hits_json", "view_court", "frame_overlays", "player_dots"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    rows = lambda df: sorted(tuple(None if v != v else round(v, 5) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False))
    assert rows(got) == rows(want)
