from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["doc_id", "position", "id", "tag", "text", "tokens"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_training_data_part(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "brookloom", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "brookloom").mkdir()
    for p in (ROOT / "brookloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "brookloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'document_blocks' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
