import json
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
LIST = "import json, __spark_entry__ as e; print(json.dumps([len(e.queries()), sorted(k for k in e.queries() if k.startswith('op') or k == 'pipeline'), set(e.oracle_sql()) <= set(e.queries())]))"


def copied(tmp_path):
    for name in ("evaquery", "__spark_entry__.py", "corpus_pipeline.py"):
        if (at := ROOT / name).is_dir():
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif at.exists():
            shutil.copy(at, tmp_path / name)
    return tmp_path


def listed(at):
    return subprocess.run([sys.executable, "-c", LIST], cwd=at, capture_output=True, text=True, timeout=300)


def test_core_queries_stand_alone(tmp_path):
    at = copied(tmp_path)
    shutil.rmtree(at / "evaquery" / "llm", ignore_errors=True)
    (at / "corpus_pipeline.py").unlink(missing_ok=True)
    n, corpus, sound = json.loads(listed(at).stdout)
    assert n > 250 and corpus == [] and sound
    (at / "evaquery" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave behind
    assert json.loads(listed(at).stdout)[0] == n


def test_errors_of_the_corpus_part_are_not_hidden(tmp_path):
    at = copied(tmp_path)
    if not (at / "evaquery" / "llm").exists():
        return
    assert len(json.loads(listed(at).stdout)[1]) == 14
    with open(at / "evaquery" / "llm" / "common.py", "a") as f:
        f.write("\nimport a_module_that_is_not_there\n")
    assert "a_module_that_is_not_there" in listed(at).stderr


def test_core_imports_nothing_of_the_corpus_part():
    for path in (ROOT / "evaquery").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
