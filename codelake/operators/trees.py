"""Syntax trees as tables, and complexity counted over them.

A tree is a row for each of its nodes with its pre-order interval: a node's descendants are those that begin within it. So what lies below a node
is a range join, and counts are aggregates; parsers only give rows.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

#: The types of nodes where a program decides.
DECISIONS = (
    "if_statement", "elif_clause", "else_clause", "for_statement", "while_statement", "do_statement", "case_statement", "switch_statement",
    "catch_clause", "except_clause", "conditional_expression", "ternary_expression", "boolean_operator", "binary_expression",
)
#: A binary expression whose text has any of these counts once more.
LOGICAL = ("&&", "||", "and", "or")

#: type, number of the node and of the last node below it in pre-order, first and last line from 0, text (of binary expressions only)
Node = tuple[str, int, int, int, int, str | None]
_TREES: dict[str, Callable[[str], list[Node]]] = {}


def register_trees(language: str, parser: Callable[[str], list[Node]]) -> None:
    """parser: text -> nodes; a text that it can't parse raises SyntaxError or ValueError."""
    _TREES[language] = parser


class _PythonNodes:
    """Nodes of Python's own syntax tree under the names of the fixed values; what has no such name has that of its class."""

    _NAMES = {
        ast.For: "for_statement", ast.AsyncFor: "for_statement", ast.While: "while_statement", ast.ExceptHandler: "except_clause", ast.IfExp: "conditional_expression",
        ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition", ast.BinOp: "binary_operator",
    }

    def __init__(self):
        self.nodes: list[list] = []

    def visit(self, node: ast.AST, elif_: bool = False) -> None:
        if isinstance(node, ast.If):
            more = node.orelse
            chained = len(more) == 1 and isinstance(more[0], ast.If) and more[0].col_offset == node.col_offset
            self._open("elif_clause" if elif_ else "if_statement", node, [node.test, *node.body], [] if chained else more, more[0] if chained else None)
        elif isinstance(node, ast.BoolOp):  # a and b and c are two operators, the one within the other
            self._operators(node, node.values)
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.While, ast.Try)):
            more = node.orelse
            own = [c for c in ast.iter_child_nodes(node) if not any(c is m for m in more)]
            self._open(self._NAMES.get(type(node), "try_statement"), node, own, more, None)
        else:
            self._open(self._NAMES.get(type(node), type(node).__name__.lower()), node, list(ast.iter_child_nodes(node)), [], None)

    def _open(self, name: str, node: ast.AST, own: list, more: list, elif_: ast.AST | None) -> None:
        at = len(self.nodes)
        first = getattr(node, "lineno", 1) - 1
        self.nodes.append([name, at, at, first, getattr(node, "end_lineno", first + 1) - 1, None])
        for child in own:
            self.visit(child)
        if more:
            start = len(self.nodes)
            self.nodes.append(["else_clause", start, start, more[0].lineno - 1, more[-1].end_lineno - 1, None])
            for child in more:
                self.visit(child)
            self.nodes[start][2] = len(self.nodes) - 1
        if elif_ is not None:
            self.visit(elif_, elif_=True)
        self.nodes[at][2] = len(self.nodes) - 1

    def _operators(self, node: ast.BoolOp, values: list[ast.AST]) -> None:
        at = len(self.nodes)
        for k in range(len(values) - 1):
            self.nodes.append(["boolean_operator", at + k, at + k, node.lineno - 1, node.end_lineno - 1, None])
        for value in values:
            self.visit(value)
        for k in range(len(values) - 1):
            self.nodes[at + k][2] = len(self.nodes) - 1


def python_nodes(text: str) -> list[Node]:
    found = _PythonNodes()
    found.visit(ast.parse(text))
    return [tuple(n) for n in found.nodes]


register_trees("python", python_nodes)


#: Nodes that are handed on together.
TOGETHER = 20_000


def _node_batches(batch: pa.RecordBatch, key: str, parsers: dict) -> Iterator[pa.RecordBatch]:
    """The nodes of a batch of key, text and language, TOGETHER at a time: one text's nodes are held as rows, never those of a batch."""
    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    names = [key, "type", "begin", "last", "first_line", "last_line", "text"]

    def packed(at: list[int], nodes: list[Node]) -> pa.RecordBatch:
        columns = zip(*nodes, strict=True) if nodes else [()] * len(types)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    at, held = [], []
    for i in range(batch.num_rows):
        text, language = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
        parser = parsers.get((language or "").lower())
        if parser is None or text is None:
            continue
        try:
            nodes = parser(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
        for start in range(0, len(nodes), TOGETHER):
            part = nodes[start : start + TOGETHER]
            at += [i] * len(part)
            held += part
            if len(held) >= TOGETHER:
                yield packed(at, held)
                at, held = [], []
    if held:
        yield packed(at, held)


def syntax_nodes(texts: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, type, begin int, last int, first_line int, last_line int, text): the nodes of the texts that have a tree.

    Texts that are null, of a language without a parser, or that can't be parsed give no rows.
    """
    parsers = dict(_TREES)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _node_batches(batch, key, parsers)

    return texts.select(key, text, language).mapInArrow(run, f"`{key}` {kind}, type string, begin int, last int, first_line int, last_line int, text string")


def weight(kind: Column, text: Column) -> Column:
    """What a node adds to the complexity of all that it lies in."""
    logical = F.lit(False)
    for part in LOGICAL:
        logical = logical | F.coalesce(F.contains(text, F.lit(part)), F.lit(False))
    return kind.isin(*DECISIONS).cast("int") + ((kind == "binary_expression") & logical).cast("int")


def tree_complexity(nodes: DataFrame, key: str) -> DataFrame:
    """(key, complexity long): one more than the weights of a tree's nodes."""
    return nodes.groupBy(key).agg((F.lit(1) + F.sum(weight(F.col("type"), F.col("text")))).alias("complexity"))


def complexity(texts: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, complexity long, by): by the syntax tree where a text has one, else by expressions over the text (null: empty); keys are unique."""
    trees = tree_complexity(syntax_nodes(texts, key, text, language), key).select(F.col(key).alias("__key"), F.col("complexity").alias("__tree"))
    met = texts.join(trees, F.col(key) == F.col("__key"), "left")
    plain = rules.complexity(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return met.select(key, F.coalesce("__tree", F.when(F.col("__tree").isNull(), plain)).alias("complexity"), F.when(F.col("__tree").isNull(), "text").otherwise("tree").alias("by"))


def definition_complexity(nodes: DataFrame, key: str, kind: str = "function_definition") -> DataFrame:
    """(key, begin, first_line, complexity long): that of each definition of a tree, by what lies below it, definitions within it included."""
    outer = nodes.where(F.col("type") == kind).select(F.col(key).alias("__key"), F.col("begin").alias("__begin"), "last", "first_line")
    inner = nodes.select(key, "begin", weight(F.col("type"), F.col("text")).alias("__weight")).where("__weight > 0")
    below = outer.join(inner, (F.col("__key") == F.col(key)) & F.col("begin").between(F.col("__begin"), F.col("last")), "left")
    counted = below.groupBy("__key", "__begin", "first_line").agg((F.lit(1) + F.coalesce(F.sum("__weight"), F.lit(0))).alias("complexity"))
    return counted.select(F.col("__key").alias(key), F.col("__begin").alias("begin"), "first_line", "complexity")
