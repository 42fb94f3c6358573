import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 45


def test_without_the_optional_parts(tmp_path):
    shutil.copytree(REPO / "pagelens", tmp_path / "pagelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) > 40 and out[-1] == "False"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["reward_summary", "coverage_product", "route_priority_chain", "motion_delta", "majority_consistency", "manifest_sanitize", "dom_localization", "reachable_pages", "text_bleu1", "discovered_paths", "element_resolution", "run_summary", "final_summary", "plan_problems", "tree_summary", "render_sanity", "progress_times", "target_resolution", "pixelmatch_pictures", "difference_clusters", "payload_run_reward", "payload_rewards", "animation_pairs", "layout_sparsity", "block_crops", "markup_tree_nodes", "evaluate_runs", "animation_sources", "animation_source_totals", "prompt_inventories", "texts_as_pages", "style_pairs", "style_page_scores", "judge_answers"])
def test_query_against_its_sql(spark, name):
    db = duckdb.connect()
    for table in os.listdir(SMALL):
        db.execute(f"create view {table.split('.')[0]} as select * from '{SMALL}/{table}'")
    mine = entry.queries()[name](spark, SMALL)
    theirs = db.sql(entry.oracle_sql()[name])
    names = sorted(theirs.columns)
    assert sorted(mine.columns) == names
    rows = lambda found: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in found)
    assert rows(mine.select(*names).collect()) == rows(theirs.select(", ".join(f'"{n}"' for n in names)).fetchall())
