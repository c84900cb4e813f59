"""The registered queries: names, columns, plans, and values in a second engine on the small tables."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, normal
from clusterlens.operators import segments
from clusterlens.plans import catalog, demo

SMALL = "/root/testdata/sf0.001"
WITHOUT_SQL: set[str] = set()
COMPARED = [
    "prj1_route", "prj2_rejects", "jon1_container_facts", "jon1_document_facts", "jon3_rm_facts", "jon5_state_as_of",
    "jon7_periods", "jon9_cells", "agg4_window_mean", "agg4_sliding_mean", "agg5_window_key_counts", "agg7_message_reducers",
    "mod3_band_default", "mod5_kmeans", "win7_baseline", "str8_idle_sessions", "fea2_training_set",
]
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == WITHOUT_SQL
    assert set(catalog.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_tables
def test_entry(spark):
    row = contract.entry(spark).first()
    assert row.n > 0 and row.slope is not None


@needs_tables
@pytest.mark.parametrize("name", COMPARED)
def test_same_values_in_second_engine(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    mine = contract.queries()[name](spark, SMALL).toPandas()
    other = db.execute(contract.oracle_sql()[name]).df()
    assert len(mine) > 0
    assert normal(mine).equals(normal(other))


@needs_tables
@pytest.mark.parametrize("name", ["jon5_state_as_of", "jon7_periods", "win4_positional", "str8_container_sessions"])
def test_plans_hold_at_scale(spark, name, monkeypatch):
    """No cross or nested-loop join; rows of crowded keys are only ordered inside (key, segment), whole keys only as summaries."""
    monkeypatch.setattr(segments, "SPLIT_ROWS", 3)
    plan = contract.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    specs = re.findall(r"windowspecdefinition\(([^()]*)", plan)
    assert specs
    assert all("_segment#" in s or not re.search(r"\b(ts|event_id|seq)#", s) for s in specs)


@needs_tables
def test_scan_is_pruned_and_filtered(spark):
    plan = contract.queries()["fun12_value_kinds"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == [
        "l_discount", "l_linenumber", "l_orderkey", "l_quantity", "l_returnflag",
    ]


@needs_tables
def test_events_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks that make and parse log text are as many as the events need, not a fixed few."""
    monkeypatch.setattr(demo, "TASK_EVENTS", 20)
    events = demo.events(spark, SMALL)
    assert events.rdd.getNumPartitions() == max(demo.TASKS, math.ceil(events.count() / 20)) > demo.TASKS


@needs_tables
def test_snapshot_text_is_parsed_once(spark):
    plan = contract.queries()["src7_json_snapshots"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "FileScan text" not in plan
