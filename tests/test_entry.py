import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent
NAMES = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def named(folder):
    lines = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.splitlines()
    return [set(line.split()) for line in lines]


def copied(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "trackforge"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path)


def corpus_names(names):
    return {n for n in names if n.startswith("op") and n[2].isdigit() or n == "pipeline"}


def test_entry_works_without_the_corpus_operators(tmp_path):
    copied(tmp_path)
    shutil.rmtree(tmp_path / "trackforge" / "llm", ignore_errors=True)
    for names in named(tmp_path):  # with a pipeline that can't be imported
        assert "isl03_possession_sequences" in names and not corpus_names(names)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    for names in named(tmp_path):
        assert "isl03_possession_sequences" in names and not corpus_names(names)


def test_entry_works_without_the_pipeline(tmp_path):
    copied(tmp_path)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert "pipeline" not in set().union(*named(tmp_path))


def test_a_broken_corpus_operator_is_an_error(tmp_path):
    copied(tmp_path)
    folder = tmp_path / "trackforge" / "llm"
    if folder.exists():
        (folder / "queries.py").write_text("from trackforge.llm import not_there\n")
        done = subprocess.run([sys.executable, "-c", NAMES], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
        assert done.returncode and "not_there" in done.stderr


def test_a_missing_library_is_a_warning(tmp_path):
    copied(tmp_path)
    folder = tmp_path / "trackforge" / "llm"
    if folder.exists():
        (folder / "queries.py").write_text("raise ModuleNotFoundError('no xxhash', name='xxhash')\n")
        assert not any(corpus_names(names) for names in named(tmp_path))
