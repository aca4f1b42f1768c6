"""The SQL that queries are checked against shows every branch it is there for."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="supplied tables are not here")
ORACLE = entry.oracle_sql()

BRANCHES = {
    "attack_interval_join": ["outside_captured_range", "NOT outside_captured_range", "detected", "NOT detected"],
    "psi_drift": ["drift_flag", "NOT drift_flag"],
    "byte_entropy_labels": ["anomaly_type = 'TCP_SYN_Flood'", "anomaly_type = 'Abnormal_Entropy' AND entropy < 1", "anomaly_type = 'Abnormal_Entropy' AND entropy > 7.7", "anomaly_type IS NULL"],
    "flow_label_cascade": ["use_time AND tier = 'pair'", "use_time AND tier = '5tuple'", "use_time AND tier = 'ip'", "tier = 'none'"],
    "calibration_budget": ["threshold_method LIKE 'alert-budget%'", "in_use = 12.0", "in_use = 77.5"],
    "adaptive_thresholds": ["applied", "NOT applied AND n < 150", "NOT applied AND psi > 0.1", "n = 300", "psi IS NULL"],
    "link_normalise": ["digest IS NULL", "digest IS NOT NULL"],
    "metrics_report": ["rule = 'evt'", "rule = 'youden'", "rule = 'target_fpr'"],
    "leaderboard_rows": ["status = 'COLLAPSED'", "eligible = 'yes'"],
    "capture_to_records": ["type = 'SLOW'", "type = 'SLOW_DISTRIBUTED'", "type = 'BYTE'", "type = 'CRITICAL_BYTE'", "type = 'RATE'", "state = 'closed'"],
    "match_diagnostics": ["five_time_hits > 0", "pair_time_hits > five_time_hits", "parseable < packets"],
    "trace_rates": ["detected > 0 AND detected < traces"],
    "detector_fusion_files": ["byte_score IS NULL", "rate_only", "byte_only"],
    "op11_merkle_veb": ["verified", "NOT verified"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(BRANCHES))
def test_branches_occur(duck, name):
    if name not in ORACLE:
        pytest.skip("its module is not installed")
    duck.execute(f"CREATE OR REPLACE TABLE result AS {ORACLE[name]}")
    for branch in BRANCHES[name]:
        assert duck.execute(f"SELECT count(*) FROM result WHERE {branch}").fetchone()[0] > 0, branch
