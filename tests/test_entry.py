"""The entry module must load before any Spark session exists."""

import os
import subprocess
import sys
from pathlib import Path


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_only_a_missing_folder_is_passed_over(tmp_path):
    """Without the training-data folders the rest is there; any other error of theirs is not hidden."""
    root = Path(__file__).parent.parent
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    package = tmp_path / "tessera"
    package.mkdir()
    for p in (root / "tessera").iterdir():
        if p.name != "llm":
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"

    def run():
        return subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})

    done = run()
    assert done.returncode == 0 and done.stdout.strip().endswith("False"), done.stderr
    (tmp_path / "corpus_pipeline.py").write_text("from tessera.functions import normalize\nfrom tessera.functions.normalize import no_such_name\n")
    done = run()
    assert done.returncode != 0 and "no_such_name" in done.stderr
