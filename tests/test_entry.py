import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_works_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "vicinal", tmp_path / "vicinal", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'l2_topk' in q and not any(n.startswith('op1') for n in q) and set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 50


def test_core_does_not_import_it():
    for p in (ROOT / "vicinal").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text().replace("vicinal/llm", ""), p


def test_every_oracle_has_a_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
