"""Every registered query against its SQL in DuckDB, on the smallest supplied tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import TABLES, rows_of  # noqa: E402

from packetgrain.plans import registry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="supplied tables are not here")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        assert got
        return
    cur = duck.execute(ORACLE[name])
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got_names == want_names
    assert got == want


@pytest.mark.parametrize(
    "name",
    ["half_split", "roc_points", "calibration_quantiles", "cusum_path", "cusum_alarms", "cusum_bounds",
     "syn_flood_trailing", "flow_windows", "tls_mask_walk", "latest_reference", "incident_sessions", "flow_lives"],
)
def test_query_with_every_key_too_large(spark, duck, limits, name):
    """The same answers when even small groups are cut in parts."""
    limits(hotRows=4, foldRows=3, tlsChunk=2, broadcastRows=1)
    test_query(spark, duck, name)


@pytest.mark.parametrize(
    "name",
    ["ngram_window_scores", "window_aggregates", "complexity_scores", "patch_segments", "heatmap_cells", "model_loss",
     "page_scores", "flagged_windows"],
)
def test_query_with_a_model_too_large_to_broadcast(spark, duck, limits, name):
    limits(modelRows=1)
    test_query(spark, duck, name)


def test_other_queries_without_the_text_operators(monkeypatch):
    def refuse(name):
        raise ImportError(name)

    monkeypatch.setattr(entry, "import_module", refuse)
    assert entry.queries() == registry.QUERIES and entry.oracle_sql() == registry.ORACLE
