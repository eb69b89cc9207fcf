"""SQL texts do not depend on the order in which modules are imported."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
CODE = """
import importlib, sys
for name in {first!r}:
    importlib.import_module("tidemark.plans." + name)
import __spark_entry__ as e
from tidemark.plans.registry import PARTS
for name, text in sorted(e.oracle_sql().items()):
    named = [p for p in PARTS if "\\n" + p + " AS (" in "\\n" + text.replace("WITH RECURSIVE ", "\\n").replace("WITH ", "\\n")]
    print(name, len(text), sorted(named))
"""


@pytest.mark.parametrize("first", [["stream_queries"], ["window_queries", "risk_queries"], ["validation_queries"]])
def test_any_import_order(first):
    run = lambda names: subprocess.run([sys.executable, "-c", CODE.format(first=names)], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert run(first) == run([])


def test_named_parts_are_there():
    import __spark_entry__
    from tidemark.plans.registry import PARTS, TEXTS

    texts = __spark_entry__.oracle_sql()
    for name, raw in TEXTS.items():
        for part in PARTS:
            own = re.search(rf"\b{part}(\([^)]*\))? AS \(", raw)
            if re.search(rf"\b(FROM|JOIN)\s+{part}\b", raw, re.I) and not own:
                assert f"{part} AS (" in texts[name], (name, part)
