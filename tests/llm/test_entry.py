"""The entry hides the absence of the corpus operators, and nothing else."""


def test_entry_hides_only_its_own_modules(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "snapledger"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    load = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    (tmp_path / "zstandard.py").write_text("raise ModuleNotFoundError(\"No module named 'zstandard'\", name='zstandard')")
    assert load().returncode != 0
    (tmp_path / "zstandard.py").unlink()
    shutil.rmtree(tmp_path / "snapledger" / "llm")
    assert load().stdout.strip() == "False"
