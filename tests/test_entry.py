import ast
import pathlib

import __spark_entry__ as entry_points

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["k", "year", "labelled", "losses", "rate"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6)} <= set(entry_points.queries())


def test_nothing_outside_imports_the_text_package():
    for path in [*ROOT.glob("tidegrid/**/*.py"), ROOT / "bench.py"]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            assert not any("llm" in n.split(".") for n in [*names, getattr(node, "module", None) or ""]), path


def test_no_local_checkpoint_or_cross_join():
    for path in ROOT.glob("tidegrid/**/*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".crossJoin(" not in text, path


def test_protocol():
    from dataclasses import asdict

    from tidegrid.plans import protocol

    good = asdict(protocol.Protocol())
    assert protocol.differences(good) == {} and protocol.differences({**good, "budgets": [0.01, 0.05, 0.10]}) == {}
    assert set(protocol.differences({**good, "window": 40, "more": 1})) == {"window", "more"}
