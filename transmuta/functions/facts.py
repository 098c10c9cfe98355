"""Syntax facts: the one piece of Python that runs on executors.

Parsing Python source is the only step the SQL engine cannot express. It is an Arrow column function, so the file
content stays on the JVM side of the row and no shuffle or self-join is needed to bring facts and content together.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from transmuta import schemas

# executors receive this function by value: they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_POS = [("line", pa.int32()), ("seq", pa.int32())]
_ARROW_FACTS = pa.struct([
    ("parse_ok", pa.bool_()), ("err_type", pa.string()), ("err_line", pa.int32()), ("err_col", pa.int32()),
    ("err_msg", pa.string()), ("err_text", pa.string()),
    ("imports", pa.list_(pa.struct([("name", pa.string())] + _POS))),
    ("from_imports", pa.list_(pa.struct([("module", pa.string()), ("level", pa.int32())] + _POS))),
    ("classes", pa.list_(pa.struct([("name", pa.string()), ("bases", pa.list_(pa.string()))] + _POS))),
    ("functions", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()),
                                      ("only_pass", pa.bool_()), ("is_async", pa.bool_()), ("seq", pa.int32())]))),
    ("asserts", pa.int32()), ("max_nesting", pa.int32()), ("max_func_lines", pa.int32()),
])


def file_facts(source: str | None) -> dict | None:
    """Facts of one file from a single breadth-first walk of its syntax tree."""
    if source is None:
        return None
    facts = {"parse_ok": True, "imports": [], "from_imports": [], "classes": [], "functions": [], "asserts": 0,
             "max_nesting": 0, "max_func_lines": 0}
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return {**facts, "parse_ok": False, "err_type": "SyntaxError", "err_line": e.lineno, "err_col": e.offset,
                "err_msg": e.msg, "err_text": e.text.strip() if e.text else None}
    except Exception as e:
        return {**facts, "parse_ok": False, "err_type": "ParseError", "err_msg": str(e)}

    seq, queue = 0, deque([(tree, 0)])
    while queue:
        node, depth = queue.popleft()
        kind = type(node)
        if kind is ast.Import:
            facts["imports"] += [{"name": a.name, "line": node.lineno, "seq": seq} for a in node.names]
        elif kind is ast.ImportFrom:
            facts["from_imports"].append(
                {"module": node.module or "", "level": node.level, "line": node.lineno, "seq": seq})
        elif kind is ast.ClassDef:
            bases = [b.id for b in node.bases if isinstance(b, ast.Name)]
            facts["classes"].append({"name": node.name, "bases": bases, "line": node.lineno, "seq": seq})
        elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            facts["functions"].append({
                "name": node.name, "line": node.lineno, "end_line": node.end_lineno, "seq": seq,
                "only_pass": len(node.body) == 1 and isinstance(node.body[0], ast.Pass),
                "is_async": kind is ast.AsyncFunctionDef})
        elif kind is ast.Assert:
            facts["asserts"] += 1
        if kind is ast.FunctionDef or kind is ast.ClassDef:
            depth += 1
            facts["max_nesting"] = max(facts["max_nesting"], depth)
        seq += 1
        queue.extend((child, depth) for child in ast.iter_child_nodes(node))

    # a later definition of the same name replaces an earlier one, in source order
    spans = {f["name"]: f["end_line"] - f["line"]
             for f in sorted(facts["functions"], key=lambda f: f["line"]) if not f["is_async"]}
    facts["max_func_lines"] = max(spans.values(), default=0)
    return facts


def _facts(content: pa.Array) -> pa.Array:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return pa.array([file_facts(text) for text in content.to_pylist()], type=_ARROW_FACTS)


def with_facts(files: DataFrame, where: Column | None = None, text_col: str = "content") -> DataFrame:
    """Add a `facts` column. Rows outside `where` send nothing to Python and get NULL facts.

    The function is marked nondeterministic so that the optimizer neither repeats it nor moves it below a shuffle.
    """
    text = F.col(text_col) if where is None else F.when(where, F.col(text_col))
    parse = F.arrow_udf(_facts, schemas.FACTS).asNondeterministic()
    return files.withColumn("facts", parse(text))


def code_facts(files: DataFrame) -> DataFrame:
    """facts as a flat table, one row per file, without the content."""
    return with_facts(files).select("repo", "path", "facts.*")


def imports(facts: DataFrame) -> DataFrame:
    """One row per imported module: each name of `import a, b` and each `from m` that names a module."""
    plain = F.transform("imports", lambda i: F.struct(
        F.lit("import").alias("kind"), i["name"].alias("module"), i["line"].alias("line"), i["seq"].alias("seq")))
    frm = F.transform(F.filter("from_imports", lambda i: i["module"] != ""), lambda i: F.struct(
        F.lit("from").alias("kind"), i["module"].alias("module"), i["line"].alias("line"), i["seq"].alias("seq")))
    return facts.select("repo", "path", F.inline(F.concat(plain, frm)))


def names_regex(prefixes: Sequence[str], names: Sequence[str]) -> str:
    """What a file must contain for a from-import of a prefix or a class base to be possible.

    Only blanks, dots and line continuations can stand between `from` and the module. Identifiers may be written in
    non-ASCII compatibility forms, so text with any non-ASCII character always qualifies.
    """
    alternatives = [rf"from[\s\\.]*(?:{'|'.join(map(re.escape, prefixes))})"] if prefixes else []
    alternatives += [re.escape(n) for n in names]
    return "|".join(alternatives + [r"[^\x00-\x7F]"])
