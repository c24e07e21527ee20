"""Every query runs on the smallest data; the catalogue and its SQL belong together."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"


def test_names():
    queries = entry_point.queries()
    assert set(entry_point.oracle_sql()) <= set(queries)
    assert {"p3_found", "p6_found", "torrent_record"} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["packet_gate", "announce_discovery", "metadata_enrich", "torrent_record", "bounded_fifo", "stats_60s", "p3_subtypes"])
def test_runs(spark, name):
    df = entry_point.queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
