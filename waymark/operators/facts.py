"""Facts out of source files (P7): what a file defines, imports, calls, reads and writes, and which addresses it names."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

Fact = tuple[str, str, int]  # kind, name, line

_URL = re.compile(r"https?://([A-Za-z0-9.-]+)")
_READS, _WRITES = {"read_csv", "read_parquet", "read_json", "read_text", "read_excel", "load"}, {"to_csv", "to_parquet", "to_json", "write_text", "to_excel", "dump"}
_BATCH_CALL = re.compile(r"(?i)^\s*(?:@?call\s+|start\s+\"[^\"]*\"\s+)?\"?([\w.\\/ -]+\.(?:bat|cmd|py|exe))\"?")
_YAML_KEY = re.compile(r"^([A-Za-z_][\w.-]*)\s*:")


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}" if _dotted(node.value) else node.attr
    return node.id if isinstance(node, ast.Name) else ""


def python_facts(source: str) -> list[Fact]:
    """Of a Python file: definitions, imports, calls, and files that calls with a constant name read or write."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return [("error", type(e).__name__, getattr(e, "lineno", None) or 0)]
    out: list[Fact] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(("function", node.name, node.lineno))
        elif isinstance(node, ast.ClassDef):
            out.append(("class", node.name, node.lineno))
        elif isinstance(node, ast.Import):
            out += [("import", a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("import", f"{'.' * node.level}{node.module or ''}.{a.name}".lstrip("."), node.lineno) for a in node.names]
        elif isinstance(node, ast.Call) and (name := _dotted(node.func)):
            out.append(("call", name, node.lineno))
            texts = [a.value for a in node.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]
            last = name.rsplit(".", 1)[-1]
            if texts and last == "open":
                mode = next((k.value.value for k in node.keywords if k.arg == "mode" and isinstance(k.value, ast.Constant)), texts[1] if len(texts) > 1 else "r")
                out.append(("writes" if set(str(mode)) & set("wax+") else "reads", texts[0], node.lineno))
            elif texts and last in _READS | _WRITES:
                out.append(("reads" if last in _READS else "writes", texts[0], node.lineno))
    return out


def _lines(source: str, pattern: re.Pattern, kind: str) -> list[Fact]:
    return [(kind, m[1].strip(), i) for i, line in enumerate(source.splitlines(), 1) if (m := pattern.match(line))]


def facts_of(path: str, source: str) -> list[Fact]:
    """By the file's ending: Python, batch and YAML files; addresses of the network in any."""
    ending = path.lower().rsplit(".", 1)[-1]
    found = python_facts(source) if ending == "py" else _lines(source, _BATCH_CALL, "call") if ending in ("bat", "cmd") else _lines(source, _YAML_KEY, "key") if ending in ("yml", "yaml") else []
    return found + [("host", m[1], i) for i, line in enumerate(source.splitlines(), 1) for m in _URL.finditer(line)]


def facts(files: DataFrame) -> DataFrame:
    """``path``, ``kind``, ``name``, ``line`` of the files in ``files`` (``path``, ``content``: bytes or text). Nothing in them is run."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                source = content if isinstance(content, str) else bytes(content or b"").decode("utf-8-sig", "replace")
                rows += [(path, *f) for f in facts_of(path, source)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line"])

    return files.select("path", "content").mapInPandas(work, "path string, kind string, name string, line long")
