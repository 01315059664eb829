"""The rest of the library never imports the llm subpackage."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_imports_llm():
    for path in (ROOT / "ledgerloom").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("ledgerloom.llm" in n for n in names), path


def test_entry_has_a_query_of_every_book():
    import __spark_entry__ as entry

    assert {"r12_claim_scores", "p2_found", "g01_rollup", "st01_daily_actions"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
