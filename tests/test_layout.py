import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom):
            yield node.module or ""
            yield from (f"{node.module}.{a.name}" for a in node.names)
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_nothing_else_imports_the_training_data_subpackage():
    for path in [*(ROOT / "gleaner").rglob("*.py"), *(ROOT / "tests").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any(m.startswith("gleaner.llm") for m in imports(path)), path


def test_entry_points():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
