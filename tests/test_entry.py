import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_the_llm_subpackage():
    code = "import sys; sys.modules['trackspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(sum(k.startswith('op') for k in e.queries()), len(e.queries()) > 40, set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["0", "True", "True"]


def test_library_does_not_import_llm():
    for path in (ROOT / "trackspark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "trackspark").parts:
            assert "llm" not in path.read_text(), path
