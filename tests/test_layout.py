import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_library_does_not_import_the_corpus_operators():
    for path in (ROOT / "barline").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in name.split(".") or name == "corpus_pipeline" for name in names), path


def test_entry_works_without_the_corpus_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    try:
        assert "breadth" in entry.queries() and "pipeline" not in entry.queries() and "breadth" in entry.oracle_sql()
    finally:
        del sys.modules["__spark_entry__"]


def test_other_missing_modules_are_errors(monkeypatch):
    import importlib
    import sys

    import pytest

    if not all((ROOT / part).exists() for part in ("corpus_pipeline.py", "barline/llm")):
        pytest.skip("the corpus operators are gone")
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("barline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    with pytest.raises(ModuleNotFoundError, match="public_tokenizers"):
        importlib.import_module("__spark_entry__")
    sys.modules.pop("__spark_entry__", None)
