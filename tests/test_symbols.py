"""Symbols of Python texts by indentation, against the language's own parser."""

import ast
import inspect
import random

from pyspark.sql import functions as F

from revlens.operators import comments, packing, search, symbols


def _parsed(text):
    lines = text.split("\n")
    out = set()
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and lines[node.lineno - 1].rstrip().endswith(":"):
            top = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            above = lines[top - 2].strip() if top > 1 else ""
            said = above.startswith("#") and bool(above.strip(" \t/*#-"))
            first = node.body[0]
            opens = isinstance(first, ast.Expr) and isinstance(first.value, (ast.Constant, ast.JoinedStr)) and (isinstance(first.value, ast.JoinedStr) or isinstance(first.value.value, (str, bytes)))
            out.add((node.name, node.lineno, opens or said))
    return out


def test_symbols_of_real_texts(spark):
    texts = [inspect.getsource(m) for m in (comments, packing, search, symbols, random, inspect)]
    texts.append("# told\n@a\n@b(1)\ndef f():\n    pass\n# ---\nclass C:\n    x = 1\n\n    # told\n\n    def g(self): pass\n\n    async def h(self):\n        b'no'\n    # told\n    def i(self):\n        return 1")
    rows = [(k, n + 1, line) for k, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    frame = spark.createDataFrame(rows, "id long, line long, text string")
    got = {}
    for r in symbols.python_symbols(frame, "id").collect():
        got.setdefault(r.id, set()).add((r.name, r.start_line, r.documented))
    for k, text in enumerate(texts):
        want = _parsed(text)
        # Heads inside strings are the only ones that a reading by lines may take besides.
        assert want <= got[k] and len(got[k]) - len(want) <= 2
    assert got[len(texts) - 1] == _parsed(texts[-1])


def test_touched_symbols_decide(spark):
    text = 'def one():\n    """Told."""\n    return 1\n\ndef two():\n    return 2\n\nx = 1'
    lines = spark.createDataFrame([(7, "a.py", n + 1, t) for n, t in enumerate(text.split("\n"))], "change long, file string, line long, text string")
    told = lambda *at: symbols.documentation(lines, spark.createDataFrame([(7, "a.py", n) for n in at], "change long, file string, line long"), "change", "file").collect()
    assert [(r.documented, r.total, [u.name for u in r.undocumented]) for r in told(3, 6)] == [(1, 2, ["two"])]
    assert told(8) == [] and [(r.documented, r.total) for r in told(1)] == [(1, 1)]
    assert lines.where(F.lit(False)).count() == 0
