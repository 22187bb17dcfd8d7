"""Source trees: which files are read, and what Python files define."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.code import extension, language

MOST_BYTES = 1 << 20
ENTITIES = "path string, kind string, name string, qualified_name string, line_start int, line_end int, error string"


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: `**` any folders, `*` and `?` within one; a glob without `/` matches at any depth,
    one that ends in `/` a whole folder."""
    folder, glob = glob.endswith("/"), glob.strip("/") if "/" not in glob.strip("/") else glob.lstrip("/").rstrip("/")
    out = re.sub(r"\\\*\\\*/", "(?:.*/)?", re.escape(glob)).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return (r"\A" if "/" in glob else r"(?:\A|/)") + out + ("/" if folder else r"(?:/|\z)")


def is_wanted(path: Column, ignore: list[str] = (), deny: list[str] = (), allow: list[str] = ()) -> Column:
    """Whether a relative path is read: a known source extension; denied globs never, ignored ones only if allowed."""
    hit = lambda globs: reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g)) for g in globs], F.lit(False))
    return language(path).isNotNull() & ~hit(deny) & (~hit(ignore) | hit(allow))


def read_tree(spark: SparkSession, folder: str, ignore: list[str] = (), deny: list[str] = (), allow: list[str] = (), most: int = MOST_BYTES) -> DataFrame:
    """(path, language, length, text) of the wanted files below a folder, up to `most` bytes; the size is tested before a
    file's content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/") + "/"
    path = F.regexp_replace(F.substring_index("path", root, -1), r"\\", "/")
    rows = files.select(path.alias("path"), "length", "content").where(F.col("length") <= most).where(is_wanted(F.col("path"), ignore, deny, allow))
    return rows.select("path", language(F.col("path")).alias("language"), "length", F.decode("content", "UTF-8").alias("text"))


def python_entities(files: DataFrame) -> DataFrame:
    """Functions and classes of Python files (path, text), with qualified names and lines; a file that cannot be parsed gives
    one row with its error. Other languages would need their own grammars."""

    def walk(node, prefix):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}::{child.name}"
                yield "class" if isinstance(child, ast.ClassDef) else "function", child.name, name, child.lineno, child.end_lineno
                yield from walk(child, name)
            else:
                yield from walk(child, prefix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"]):
                try:
                    out += [(path, *e, None) for e in walk(ast.parse(text), path.removesuffix(".py").replace("/", "::"))]
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append((path, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTITIES.split(", ")]).astype(object).where(lambda x: x.notna(), None)

    return files.where("text is not null").where(extension(F.col("path")) == "py").select("path", "text").mapInPandas(run, ENTITIES)


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two snapshots (path, hash): added, removed or modified."""
    a, b = old.select("path", F.col("hash").alias("x")), new.select("path", F.col("hash").alias("y"))
    rows = a.join(b, "path", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return rows.select("path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("modified").alias("change"))
