"""A few queries in two sessions of their own, generated code on and off: the same rows."""

import json
import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ("normalize_all", "classified_blocks", "hierarchy_depth", "graph_fingerprint", "action_replay", "audit_page", "search_ranked_topk")
RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry

compiled, sf, names = sys.argv[1] == "on", sys.argv[2], sys.argv[3:]
build = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
build = build.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
if not compiled:
    build = build.config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
spark = build.getOrCreate()
for name in names:
    rows = entry.queries()[name](spark, sf)
    print("ROWS " + json.dumps([name, rows.columns, sorted(repr(tuple(r)) for r in rows.collect())]))
"""


def rows_of(mode):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run(
        [sys.executable, "-c", RUN, mode, SF, *NAMES], cwd=repo, capture_output=True, text=True, timeout=900, env=os.environ | {"PYTHONPATH": repo},
    )
    found = [json.loads(line[5:]) for line in run.stdout.splitlines() if line.startswith("ROWS ")]
    assert [f[0] for f in found] == list(NAMES), run.stdout[-1000:] + run.stderr[-3000:]
    return found


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_compiled_plans_give_the_same_rows():
    plain, compiled = rows_of("off"), rows_of("on")
    assert all(rows for _, _, rows in plain)
    assert plain == compiled
