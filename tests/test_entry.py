"""The driver's three functions, and that everything else lives without the text operators."""

import ast
import pathlib

import __spark_entry__

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert row["account_id"].startswith("acc_")


def test_every_oracle_has_its_query():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(names) > 70


def test_nothing_outside_imports_the_text_operators():
    for path in (ROOT / "ledgerforge").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in name.split(".") for name in names), path
