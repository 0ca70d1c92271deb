"""Unified diffs: patches(key..., filename, patch) to lines, hunks, numbers and snippets, by counting and string functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
_STARTS = re.compile(r"@@ -([0-9]+)(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@").match


def numbered_rows(patches: DataFrame, *key: str) -> DataFrame:
    """(key..., pos, line, hunk, kind, old_line, new_line): the lines of each patch with the hunk they are in (0: before any) and their numbers.

    kind is header, add, delete, context or other. A removed line's new_line is the number that the next line has.
    """
    # Lines leave a patch in their order, so counting as they come needs no sort of them.
    whole = patches.where(F.col("patch").isNotNull()).select(*key, "patch")
    kept = ", ".join(f"`{k}` {whole.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size = 0, 0
            for i, bytes_ in enumerate(pc.fill_null(pc.binary_length(batch.column(len(key))), 0).to_pylist()):
                if size and size + bytes_ > TOGETHER:
                    yield from _numbered(batch.slice(start, i - start))
                    start, size = i, 0
                size += bytes_
            yield from _numbered(batch.slice(start))

    return whole.mapInArrow(run, f"{kept}, pos int, line string, hunk long, kind string, old_line long, new_line long")


#: Bytes of patches that are cut into lines together, and lines that are handed on together.
TOGETHER, LINES = 1 << 20, 20_000


def _numbered(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """numbered_rows of a few patches: a key's columns and, last, the patch."""
    cut = pc.split_pattern(batch.column(batch.num_columns - 1), "\n")
    of, line = np.asarray(pc.list_parent_indices(cut), np.int64), pc.list_flatten(cut)
    n, begins = len(line), lambda s: np.asarray(pc.starts_with(line, s))
    if not n:
        return
    header, place = begins("@@"), np.arange(n)
    first = np.searchsorted(of, of)  # the first line of each line's patch
    code = np.select([header, begins("+") & ~begins("+++"), begins("-") & ~begins("---"), begins(" ")], [0, 1, 2, 3], 4)
    ahead = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    heads, old, new = ahead(header), ahead((code == 2) | (code == 3)), ahead((code == 1) | (code == 3))
    hunk = heads[place + 1] - heads[first]
    # The header of each line's hunk; the numbers of lines before any header, or below one that can't be read, are null.
    at = np.flatnonzero(header)
    opened = np.where(hunk > 0, np.append(at, 0)[heads[place + 1] - 1], 0)
    told = np.full((2, n), -1)
    for i, text in zip(at, line.take(pa.array(at)).to_pylist(), strict=True):
        for k, digits in enumerate(_STARTS(text).groups() if _STARTS(text) else ()):
            told[k, i] = int(digits) if int(digits) < 1 << 31 else -1
    numbers = [pa.array(told[k, opened] + moved[place] - moved[opened], mask=(hunk == 0) | (told[k, opened] < 0)) for k, moved in enumerate((old, new))]
    kinds = pa.array(["header", "add", "delete", "context", "other"]).take(pa.array(code))
    out = pa.RecordBatch.from_arrays(
        [*(batch.column(k).take(pa.array(of)) for k in range(batch.num_columns - 1)), pa.array((place - first).astype(np.int32)), line, pa.array(hunk), kinds, *numbers],
        names=[*batch.schema.names[:-1], "pos", "line", "hunk", "kind", "old_line", "new_line"],
    )
    for start in range(0, n, LINES):
        yield out.slice(start, LINES)


def patch_lines(patches: DataFrame, *key: str) -> DataFrame:
    """(key..., pos, type, content): added and deleted lines. A line that begins with +++ or --- is a file's header, never content."""
    rows = patches.where(F.col("patch").isNotNull()).select(*key, F.posexplode(F.split("patch", "\n")).alias("pos", "line"))
    kind = F.when(F.startswith("line", F.lit("+")) & ~F.startswith("line", F.lit("+++")), "add").when(F.startswith("line", F.lit("-")) & ~F.startswith("line", F.lit("---")), "delete")
    return rows.withColumn("type", kind).where("type is not null").select(*key, "pos", "type", F.expr("substr(line, 2)").alias("content"))


def patch_hunks(patches: DataFrame, *key: str) -> DataFrame:
    """(key..., hunk, lines, text): each hunk from its header on; what stands before the first is left out."""
    parts = patches.select(*key, F.startswith("patch", F.lit("@@")).cast("long").alias("first"), F.posexplode(F.split("patch", "\n(?=@@)")).alias("i", "text"))
    return parts.where(F.startswith("text", F.lit("@@"))).select(*key, (F.col("i") + F.col("first")).alias("hunk"), F.size(F.split("text", "\n")).cast("long").alias("lines"), "text")


def patch_metrics(patches: DataFrame, *key: str) -> DataFrame:
    rows = numbered_rows(patches, *key)
    is_ = lambda k: F.count_if(F.col("kind") == k)
    return rows.groupBy(*key).agg(is_("add").alias("lines_added"), is_("delete").alias("lines_removed"), is_("header").alias("hunks"))


def numbered_diff(patches: DataFrame, *key: str) -> DataFrame:
    """(key..., pos, shown): lines as a reviewer sees them, with the number and marker of each."""
    rest = F.expr("substr(line, 2)")
    shown = (
        F.when(F.col("kind") == "add", F.concat(F.lit("L"), "new_line", F.lit("+ | "), rest))
        .when(F.col("kind") == "delete", F.concat(F.lit("L"), "old_line", F.lit("- | "), rest))
        .when(F.col("kind") == "context", F.concat(F.lit("L"), "new_line", F.lit("  | "), rest))
        .otherwise(F.col("line"))
    )
    return numbered_rows(patches, *key).select(*key, "pos", shown.alias("shown"))


def snippet_around(patches: DataFrame, targets: DataFrame, *key: str, context: int = 3) -> DataFrame:
    """targets(key..., target): the lines within `context` of a new line number: (key..., target, start_line, end_line, has_target, snippet).

    A removed line counts at the number of the line before it; only an added line at the target is marked."""
    rows = numbered_rows(patches, *key).where("kind in ('add', 'delete', 'context') and hunk > 0")
    at = F.when(F.col("kind") == "delete", F.col("new_line") - 1).otherwise(F.col("new_line"))
    near = rows.withColumn("at", at).join(targets, list(key)).where(F.abs(F.col("at") - F.col("target")) <= context)
    marked = (F.col("kind") == "add") & (F.col("at") == F.col("target"))
    sign = F.when(F.col("kind") == "add", "+").when(F.col("kind") == "delete", "-").otherwise(" ")
    text = F.format_string("%s%3d %s %s", F.when(marked, "→").otherwise(" "), F.col("at"), sign, F.expr("substr(line, 2)"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("text")))), lambda x: x["text"]), "\n")
    return near.groupBy(*key, "target").agg(F.min("at").alias("start_line"), F.max("at").alias("end_line"), F.bool_or(F.col("at") == F.col("target")).alias("has_target"), parts.alias("snippet"))


def hunk_ranges(patches: DataFrame, *key: str) -> DataFrame:
    """(key..., first, last): the new lines of each hunk; the line after its last one counts, too."""
    heads = numbered_rows(patches, *key).where("kind = 'header'")
    first, length = F.regexp_extract("line", HUNK, 2), F.regexp_extract("line", HUNK, 3)
    heads = heads.select(*key, first.try_cast("int").alias("first"), F.coalesce(length.try_cast("int"), F.lit(1)).alias("length"))
    return heads.where("first is not null").select(*key, "first", (F.col("first") + F.col("length")).alias("last"))


def lines_in_diff(refs: DataFrame, patches: DataFrame, key: str, file_col: str = "filename") -> DataFrame:
    """refs(key, file, line) with in_diff: whether a hunk of a matching file of the same key has the line. `unknown` matches every file."""
    ranges = hunk_ranges(patches, key, file_col)
    numbered = refs.withColumn("__ref", F.struct("file", "line"))
    fits: Column = (F.col("file") == "unknown") | F.endswith(file_col, "file") | F.contains(file_col, "file")
    hits = refs.distinct().join(ranges, key).where(fits & F.col("line").between(F.col("first"), F.col("last"))).select(key, "file", "line").distinct().withColumn("__hit", F.lit(True))
    return numbered.drop("__ref").join(hits, [key, "file", "line"], "left").withColumn("in_diff", F.coalesce("__hit", F.lit(False))).drop("__hit")


def pr_content(patches: DataFrame, *key: str) -> DataFrame:
    """(key..., content): the new side of a patch - added and kept lines without their marker; files that are deleted or removed are left out."""
    rows = patches.where(~F.coalesce(F.col("status"), F.lit("")).isin("deleted", "removed")) if "status" in patches.columns else patches
    lines = numbered_rows(rows, *key).where("kind in ('add', 'context')").select(*key, "pos", F.expr("substr(line, 2)").alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(*key).agg(text.alias("content"))


def formatted_diff(patches: DataFrame, *key: str, file_col: str | None = None) -> DataFrame:
    """(key..., text): the whole numbered diff of each patch, an empty line before each hunk, under the file's name; a note where there is no patch.

    Keys are unique. A null or empty file name has no heading.
    """
    lines = numbered_diff(patches, *key)
    line = F.when(F.col("shown").startswith("@@"), F.concat(F.lit("\n"), "shown")).otherwise(F.col("shown"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n")
    met = patches.select(*key, "patch", *([] if file_col is None else [F.col(file_col).alias("__file")])).join(lines.groupBy(*key).agg(text.alias("__text")), list(key), "left")
    head = F.lit("") if file_col is None else F.when(F.coalesce("__file", F.lit("")) != "", F.concat(F.lit("## File: "), "__file", F.lit("\n\n"))).otherwise("")
    blank = F.coalesce(F.col("patch").rlike(r"(?U)\A\s*\z"), F.lit(True))
    return met.select(*key, F.when(blank, "No diff available").otherwise(F.concat(head, "__text")).alias("text"))
