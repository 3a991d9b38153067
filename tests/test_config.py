"""Settings, the command line, and the entry point without the text operators."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from orrery.__main__ import main
from orrery.config import Settings

ROOT = Path(__file__).resolve().parent.parent


def test_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"shuffle_partitions": 7, "shared_folder": "/shared"}))
    s = Settings.of(tmp_path / "s.json").updated(log_level="ERROR")
    assert s.spark_conf() == {"spark.app.name": "orrery", "spark.sql.shuffle.partitions": "7", "spark.checkpoint.dir": "/shared"}
    with pytest.raises(KeyError, match="no setting colour"):
        Settings.of({"colour": 1})
    with pytest.raises(KeyError, match="no setting cutof"):
        s.updated(cutof=1)


def test_command_line(spark, tmp_path, capsys):
    from orrery.sources.store import FeatureStore

    rows = [("k", 3, x, y, z, float(x + y * z)) for x in range(2) for y in range(3) for z in range(2)]
    FeatureStore(spark, str(tmp_path)).append(spark.createDataFrame(rows, "outkey string, sample_id long, gx int, gy int, gz int, v double"))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    main(["view-slice", str(tmp_path), "k", "3", "--at", "1"])
    main(["view-voxel", str(tmp_path), "k", "3", "--percentile", "90"])
    main(["queries"])
    out = capsys.readouterr().out.splitlines()
    assert out[:3] == ["0.000 0.333", "0.333 0.667", "0.667 1.000"] and out[3] == "1 2 1 3" and "featurize" in out
    assert spark.conf.get("spark.sql.shuffle.partitions") == n


def test_entry_without_text_operators(tmp_path):
    """Without that subpackage and the pipeline the rest imports; with them, a missing dependency isn't hidden."""
    shutil.copytree(ROOT / "orrery", tmp_path / "orrery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    ask = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    env = {**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    n = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(n[0]) > 150 and n[2] == "False"
    if not (ROOT / "orrery" / "llm").exists():
        return
    shutil.copytree(ROOT / "orrery" / "llm", tmp_path / "orrery" / "llm", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    whole = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(whole[0]) == int(n[0]) + 11
    broken = subprocess.run([sys.executable, "-c", "import sys; sys.modules['zstandard'] = None; " + ask], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert broken.returncode and "zstandard" in broken.stderr
