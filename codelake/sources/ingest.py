"""Ingest: scan of source files, captures of definitions by language, entity and chunk projections, imports.

Captures come from parsers that are registered by language and run once per file on the executors; a file that can't be parsed gives no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions and the languages they stand for.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".vue": "vue", ".html": "html", ".css": "css", ".json": "json",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".php": "php", ".cs": "c_sharp", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
    ".sh": "bash", ".lua": "lua", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".tf": "hcl", ".dockerfile": "dockerfile", ".make": "make", ".md": "markdown",
}

# Folders that a scan passes by.
IGNORED = (".git", ".github", ".vscode", ".idea", "node_modules", "venv", "env", "dist", "build", "out", "target", "bin", "obj", "__pycache__", "coverage", "tmp", "temp", "migrations")

# Labels of node types and of tags.
LABELS = {
    "function_definition": "Function", "function_declaration": "Function", "method_definition": "Function", "method_declaration": "Function", "class_definition": "Class", "class_declaration": "Class",
    "interface_declaration": "Interface", "internal_module": "Module", "struct_item": "Struct", "function_item": "Function", "impl_item": "Class",
    "definition.function": "Function", "definition.method": "Function", "definition.macro": "Function", "definition.entrypoint": "Function", "definition.class": "Class", "definition.interface": "Interface",
    "definition.module": "Module", "definition.import": "Import", "definition.implementation": "Class",
    "definition.resource": "Resource", "definition.variable": "Variable", "definition.section": "Section", "definition.key": "ConfigKey", "definition.config": "Config", "definition.base_image": "BaseImage",
    "definition.instruction": "Instruction", "definition.stage": "Stage", "definition.target": "Target", "definition.script": "Script", "definition.style": "Style",
}

# Node types whose code is embedded, and extensions of which everything is.
CHUNK_TYPES = ("function_definition", "function_declaration", "function_item", "method_definition", "method_declaration", "class_definition", "class_declaration", "interface_declaration", "impl_item", "table", "block")
TEMP_TYPES = ("function_definition", "function_declaration", "function_item", "method_definition", "method_declaration", "class_definition", "class_declaration")
CONFIG_EXTENSIONS = (".yaml", ".yml", ".toml", ".tf", ".dockerfile")


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def language_of(path: Column) -> Column:
    """The language that a path's extension stands for, in lower case; null if it is none."""
    return _lookup(LANGUAGES, F.lower(extension(path)))


def scan_files(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """(repo_id, file, language, content): files below root of a known language outside ignored folders. The filter on names reaches the listing's rows before contents are used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    path = F.expr("substring_index(path, ':', -1)")
    relative = F.regexp_replace(F.replace(path, base, F.lit("")), "^/+", "")
    rows = files.select(F.lit(repo_id).alias("repo_id"), relative.alias("file"), language_of(relative).alias("language"), "content")
    return rows.where(F.col("language").isNotNull() & ~F.exists(F.split("file", "/"), lambda p: p.isin(*IGNORED)))


Capture = tuple[str, str, str, int, int, str]
_PARSERS: dict[str, Callable[[str], list[Capture]]] = {}


def register_language(name: str, parser: Callable[[str], list[Capture]]) -> None:
    """parser: text -> (node_type, capture, name, start_line, end_line, code), lines from 0."""
    _PARSERS[name] = parser


def python_captures(text: str) -> list[Capture]:
    lines, out = text.split("\n"), []

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class_definition" if isinstance(child, ast.ClassDef) else "function_definition"
                out.append((kind, "item", child.name, child.lineno - 1, child.end_lineno - 1, "\n".join(lines[child.lineno - 1 : child.end_lineno])))
            visit(child)

    visit(ast.parse(text))
    return out


_HEADERS = {
    "js": [("class_declaration", r"\bclass\s+([A-Za-z_$][\w$]*)"), ("function_declaration", r"\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)\s*\("), ("method_definition", r"^\s+(?:async\s+|static\s+|get\s+|set\s+)*([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?::[^{};]+)?\{"), ("interface_declaration", r"\binterface\s+([A-Za-z_$][\w$]*)")],
    "go": [("function_declaration", r"^func\s+([A-Za-z_]\w*)\s*\("), ("method_declaration", r"^func\s+\([^)]*\)\s*([A-Za-z_]\w*)\s*\("), ("struct_item", r"^type\s+([A-Za-z_]\w*)\s+struct\b"), ("interface_declaration", r"^type\s+([A-Za-z_]\w*)\s+interface\b")],
    "rust": [("function_item", r"\bfn\s+([A-Za-z_]\w*)"), ("struct_item", r"\bstruct\s+([A-Za-z_]\w*)"), ("impl_item", r"\bimpl(?:<[^>]*>)?\s+([A-Za-z_]\w*)"), ("interface_declaration", r"\btrait\s+([A-Za-z_]\w*)")],
    "java": [("class_declaration", r"\bclass\s+([A-Za-z_]\w*)"), ("interface_declaration", r"\binterface\s+([A-Za-z_]\w*)"), ("method_declaration", r"^\s+(?:[\w<>\[\],.?]+\s+)+([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:throws\s+[\w,\s.]+)?\{")],
    "c": [("function_definition", r"^[A-Za-z_][\w\s*&:<>,~]*?\b([A-Za-z_~]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?\{"), ("struct_item", r"\bstruct\s+([A-Za-z_]\w*)\s*\{"), ("class_declaration", r"\bclass\s+([A-Za-z_]\w*)")],
    "php": [("class_declaration", r"\b(?:class|trait)\s+([A-Za-z_]\w*)"), ("interface_declaration", r"\binterface\s+([A-Za-z_]\w*)"), ("function_definition", r"\bfunction\s+([A-Za-z_]\w*)\s*\(")],
    "sh": [("function_definition", r"^(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{")],
}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "new", "sizeof"}


def _masked(text: str) -> str:
    """The text with strings and comments blanked, of the same length and lines."""
    pattern = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def brace_captures(family: str) -> Callable[[str], list[Capture]]:
    """Definitions of languages with braces: headers by pattern, ends by matching braces, strings and comments aside."""
    headers = [(kind, re.compile(p, re.MULTILINE)) for kind, p in _HEADERS[family]]

    def parse(text: str) -> list[Capture]:
        plain, out = _masked(text), []
        for kind, pattern in headers:
            for m in pattern.finditer(plain):
                if m[1] in _NOT_NAMES:
                    continue
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                at, depth = plain.find("{", m.start()), 0
                end = m.end()
                while at >= 0:
                    for i in range(at, len(plain)):
                        depth += (plain[i] == "{") - (plain[i] == "}")
                        if not depth:
                            end = i + 1
                            break
                    break
                out.append((kind, "item", m[1], plain.count("\n", 0, start), plain.count("\n", 0, end), text[start:end]))
        return sorted(out, key=lambda c: (c[3], c[4]))

    return parse


def keyed_captures(pattern: str, kind: str, capture: str) -> Callable[[str], list[Capture]]:
    """One capture a line that the pattern names; it ends before the next one."""
    find = re.compile(pattern)

    def parse(text: str) -> list[Capture]:
        lines = text.split("\n")
        at = [(i, m[1]) for i, line in enumerate(lines) if (m := find.match(line))]
        ends = [i - 1 for i, _ in at[1:]] + [len(lines) - 1]
        return [(kind, capture, name, i, end, "\n".join(lines[i : end + 1])) for (i, name), end in zip(at, ends, strict=True)]

    return parse


register_language("python", python_captures)
for _name, _family in {"javascript": "js", "typescript": "js", "tsx": "js", "go": "go", "rust": "rust", "java": "java", "c_sharp": "java", "c": "c", "cpp": "c", "php": "php", "bash": "sh"}.items():
    register_language(_name, brace_captures(_family))
register_language("ruby", keyed_captures(r"\s*(?:def|class|module)\s+([\w.:?!]+)", "method_definition", "definition.method"))
register_language("lua", keyed_captures(r"\s*(?:local\s+)?function\s+([\w.:]+)", "function_declaration", "definition.function"))
register_language("toml", keyed_captures(r"\s*\[+\s*([^\]]+?)\s*\]+", "table", "definition.section"))
register_language("yaml", keyed_captures(r"([A-Za-z_][\w-]*)\s*:", "block", "item"))
register_language("hcl", keyed_captures(r'(?:resource|data|variable|output|module|provider|locals)\s*"?([\w.-]*)', "block", "definition.resource"))
register_language("dockerfile", keyed_captures(r"(?i)(FROM\s+\S+|ENV\s+\w+|ARG\s+\w+|RUN|CMD|ENTRYPOINT|COPY|WORKDIR|EXPOSE|USER|VOLUME|LABEL)\b", "instruction", "definition.instruction"))
register_language("make", keyed_captures(r"([A-Za-z0-9_.-]+)\s*:(?!=)", "rule", "definition.target"))
register_language("vue", keyed_captures(r"<(script|style)\b", "element", "definition.script"))
register_language("html", keyed_captures(r".*?\bid=[\"']([^\"']+)", "element", "item"))
register_language("css", keyed_captures(r"([^{}@\s][^{}]*?)\s*\{", "rule_set", "item"))
register_language("json", keyed_captures(r'\s*"([^"]+)"\s*:', "pair", "item"))
register_language("markdown", keyed_captures(r"#+\s+(.*)", "atx_heading", "item"))

CAPTURES = "repo_id string, file string, language string, idx int, node_type string, capture string, name string, start_line int, end_line int, code string"


def captures(files: DataFrame) -> DataFrame:
    """Captures of files(repo_id, file, language, content binary): bytes that aren't UTF-8 are left out, a parse error gives no rows."""
    parsers = dict(_PARSERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, file, language, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                parser = parsers.get(language or "")
                if parser is None or content is None:
                    continue
                try:
                    found = parser(content.decode("utf-8", "ignore"))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [(repo, file, language, i, *c) for i, c in enumerate(found)]
            names = [c.split(" ")[0] for c in CAPTURES.split(", ")]
            types = [pa.int32() if c.endswith(" int") else pa.string() for c in CAPTURES.split(", ")]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.select("repo_id", "file", "language", "content").mapInArrow(run, CAPTURES)


def label(node_type: Column, capture: Column) -> Column:
    """The label of the node type, else of the tag, else by what the type's name contains; null: not an entity."""
    guess = F.when(node_type.contains("function") | node_type.contains("method"), "Function").when(node_type.contains("class") | node_type.contains("struct"), "Class")
    return F.coalesce(_lookup(LABELS, node_type), _lookup(LABELS, F.regexp_replace(capture, "^@+|@+$", "")), guess)


def clean_name(name: Column) -> Column:
    return F.btrim(F.btrim(name, F.lit('"')), F.lit("'"))


def entity_name(name: Column, code: Column, identifiers: Column, line: Column) -> Column:
    """A node's name: its name field, else its text if that is one line, else the first of its children's identifiers (an array, null: none), else one made
    of its line; without quotes around it."""
    one_line = F.when(~F.contains(code, F.lit("\n")), code)
    return clean_name(F.coalesce(name, one_line, F.try_element_at(identifiers, F.lit(1)), F.concat(F.lit("anon_"), line)))


def entities(found: DataFrame) -> DataFrame:
    """Entity rows of captures, with capture_idx for last_captured; identifiers, an array of those among a node's children, may be a column."""
    identifiers = F.col("identifiers") if "identifiers" in found.columns else F.lit(None).cast("array<string>")
    name = entity_name(F.col("name"), F.col("code"), identifiers, F.col("start_line"))
    named = found.withColumn("type", label(F.col("node_type"), F.col("capture"))).where("type is not null").withColumn("name", name)
    uid = F.concat_ws("::", "repo_id", "file", "name")
    return named.select("repo_id", "file", "name", "type", "start_line", "end_line", F.col("code").alias("raw_code"), uid.alias("uid"), F.col("idx").alias("capture_idx"))


def chunks(found: DataFrame) -> DataFrame:
    """What is embedded: captures of at least three lines more than one, of code types or in configuration files."""
    fit = (F.col("end_line") - F.col("start_line") >= 3) & (F.col("node_type").isin(*CHUNK_TYPES) | extension(F.col("file")).isin(*CONFIG_EXTENSIONS))
    first = F.element_at(F.split("code", r"\r\n|[\n\r\f\x0b\x1c-\x1e\x85  ]"), 1)
    key = F.sha2(F.concat_ws("::", "repo_id", "file", "start_line", "name"), 256)
    return found.where(fit).select(key.alias("id"), "repo_id", "file", F.trim(F.substring(first, 1, 100)).alias("name"), label(F.col("node_type"), F.col("capture")).alias("type"), "start_line", F.col("code").alias("raw_code"))


def temp_nodes(found: DataFrame) -> DataFrame:
    """(id, name, type, file, line, end_line, code, language): the nodes of a graph that isn't kept, from captures of the seven types of functions, methods
    and classes. The name is the first line, stripped, of 100 characters at most; the id is made of file, line and name. Null code makes no node."""
    name = F.substring(F.regexp_replace(F.split_part("code", F.lit("\n"), F.lit(1)), r"(?U)^\s+|\s+$", ""), 1, 100)
    key = F.substring(F.md5(F.concat_ws(":", "file", F.col("start_line").cast("string"), name)), 1, 16)
    own = found.where(F.col("node_type").isin(*TEMP_TYPES) & F.col("code").isNotNull())
    return own.select(key.alias("id"), name.alias("name"), F.col("node_type").alias("type"), "file", F.col("start_line").alias("line"), "end_line", "code", "language")


def imports(files: DataFrame) -> DataFrame:
    """(repo_id, file, import): distinct imports of Python and JavaScript or TypeScript files(repo_id, file, language, text).

    Python: the first word behind `import `, with a comma if it has one, or what stands between `from ` and `import`. Scripts: of a line with both
    `import` and `from`, what stands between the first `from` and the next, without semicolons and quotes around it.
    """
    lines = files.select("repo_id", "file", "language", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    part = lambda text, by, n: F.try_element_at(F.split(text, by), F.lit(n))
    trimmed = lambda text: F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    python = F.when(F.col("line").startswith("import "), part(F.regexp_replace(F.replace("line", F.lit("import "), F.lit("")), r"(?U)^\s+", ""), r"(?U)\s+", 1))
    python = python.when(F.col("line").startswith("from "), trimmed(part(part(F.col("line"), "from ", 2), "import", 1)))
    script = trimmed(part(F.col("line"), "from", 2))
    for quote in (";", '"', "'"):
        script = F.btrim(script, F.lit(quote))
    script = F.when(F.col("line").contains("import") & F.col("line").contains("from"), script)
    found = F.when(F.col("language").isin("python", "py"), python).when(F.col("language").isin("javascript", "typescript", "jsx", "tsx"), script)
    return lines.withColumn("import", found).where("import <> ''").select("repo_id", "file", "import").distinct()
