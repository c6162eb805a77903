import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_oracles_parse():
    con = duckdb.connect()
    for name, text in entry.oracle_sql().items():
        assert con.execute("SELECT json_serialize_sql($1)", [text]).fetchone()[0], name


@needs_data
def test_flagship_schema(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "pre_event_value_a" in df.columns


@needs_data
def test_sample_of_queries_against_duckdb():
    names = ["event_cutoffs", "trailing_supply", "safe_trailing_mean", "asof_release_join", "snapshot_diff", "fold_manifest_digests"]
    run = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "check_queries.py"), SF, *names], capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stdout[-3000:] + run.stderr[-1000:]
