"""The driver contract: from another folder, and without the optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
RUN = """
import sys, tempfile
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.sql.codegen.fallback", "false").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(dir={tmp!r})).getOrCreate())
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names and entry.entry(spark).count() > 0
assert any(n.startswith("op") and "_" in n and n[2].isdigit() for n in names) == {llm} and ("pipeline" in names) == {pipeline}
assert entry.queries()["overlap_area"](spark, "/root/testdata/sf0.001").count() > 0
"""


def copied(tmp_path, *without):
    to = tmp_path / "copy"
    shutil.copytree(REPO, to, ignore=lambda folder, names: {n for n in names if n in (".git", "__pycache__") or str((Path(folder) / n).relative_to(REPO)) in without})
    return to


@pytest.mark.parametrize(("without", "llm", "pipeline"), [(("corpus_pipeline.py",), True, False), (("gridindex/llm", "tests/llm"), False, False)])
def test_from_another_folder(tmp_path, without, llm, pipeline):
    have = (REPO / "gridindex/llm/queries.py").exists(), (REPO / "corpus_pipeline.py").exists()
    repo = copied(tmp_path, *without)
    code = RUN.format(repo=str(repo), tmp=str(tmp_path), llm=llm and have[0], pipeline=pipeline and all(have))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
