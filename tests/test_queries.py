"""Every registered query has a name, and a sample of them equals its SQL; ROAM_ALL_QUERIES=1 runs all."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from roamframe.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
SAMPLE = [
    "flagship_brand_buyers", "graph_edges_unique", "graph_edges_parallel", "graph_subgraph", "graph_merge_with", "scan_all_edges", "step_out_grouped",
    "step_out_sorted", "filter_lookahead_between", "filter_with_set", "filter_prevent_cycles", "section_first_two", "branch_round_robin", "order_take_drop",
    "aggregate_index_by_multi", "path_full", "recurse_deepest", "descend_emit_and_cut", "algo_strong_components", "algo_immediate_dominators", "order_loop_tree",
    "recipe_recommendation", "motif_squares", "view_weight_defaults",
]


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return connection


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x) -> str:
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        return f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ROAM_ALL_QUERIES") else SAMPLE)
def test_query_equals_its_sql(spark, sql, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    want = sql.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_everything_imports_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "roamframe", tmp_path / "roamframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op')] and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
