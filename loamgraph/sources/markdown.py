"""Records kept as Markdown files: frontmatter between `---` lines, then the body."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.times import USABLE
from loamgraph.operators.consolidate import TRANSITIONS
from loamgraph.session import durable

TYPES, VOLATILITIES, STATUSES = ("observation", "rule", "knowledge"), ("living", "record"), tuple(TRANSITIONS)
SCHEMA = (
    "path string, id string, title string, type string, status string, created_at string, updated_at string, refs array<string>, properties map<string,string>, body string, content_hash string, error string"
)
COMMON = ("id", "title", "type", "status", "created_at", "updated_at", "references")
TIME = re.compile(USABLE.replace(r"\z", r"\Z").replace("T ", "Tt "))


class Malformed(ValueError):
    """A text that is no record file."""


def split(text: str) -> tuple[str, str]:
    """(frontmatter, body). The text must begin with a line `---` and hold another; one blank line after it is dropped."""
    lines = text.split("\n")
    if lines[0] not in ("---", "---\r") or len(lines) < 2:
        raise Malformed("no frontmatter")
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip("\r") == "---"), None)
    if end is None:
        raise Malformed("frontmatter does not end")
    body = lines[end + 1 :]
    if body and body[0] == "":
        body = body[1:]
    return "\n".join(lines[1:end]), "\n".join(body)


def _unquoted(text: str) -> str:
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return re.sub(r"\\([\\\"'])", r"\1", text[1:-1])
    return text


def value(text: str):
    """A scalar or a list of texts: empty, `~` and `null` are the empty text; then lists, booleans, integers, floats, quoted
    and plain texts."""
    if text in ("", "~", "null"):
        return ""
    if text[0] == "[" and text[-1] == "]":
        items = re.findall(r"""\s*("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^,]+)\s*(?:,|$)""", text[1:-1])
        return [_unquoted(x.strip()) for x in items]
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"[+-]?\d+", text) and -(2**63) <= int(text) < 2**63:
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|infinity|nan)", text, re.IGNORECASE):
        return float(text)
    return _unquoted(text)


def parse(text: str) -> dict:
    """Keys in order; blank lines and comments are skipped, the last of a repeated key wins."""
    out = {}
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, colon, rest = line.partition(":")
        if not colon or not key.strip():
            raise Malformed(f"line {n}: no key")
        out[key.strip()] = value(rest.strip())
    return out


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def serialise(fields: dict) -> str:
    """The text that parses to these fields."""
    out = []
    for key, v in fields.items():
        if isinstance(v, bool):
            text = str(v).lower()
        elif isinstance(v, int):
            text = str(v)
        elif isinstance(v, float):
            text = repr(v)
        elif isinstance(v, list):
            text = "[" + ", ".join(map(_quoted, v)) + "]"
        else:
            plain = v == v.strip() and v != "" and value(v) == v and v[0] not in "\"'[#" and "\n" not in v
            text = v if plain else _quoted(v)
        out.append(f"{key}: {text}\n")
    return "".join(out)


def record(text: str) -> dict:
    """A validated record of a file's text; raises Malformed."""
    head, body = split(text)
    fields = parse(head)

    def text_of(key: str, default: str | None = None) -> str:
        v = fields.get(key, default)
        if not isinstance(v, str) or key in ("id", "type") and not v:
            raise Malformed(f"no {key}")
        return v

    out = {k: text_of(k) for k in ("id", "title", "type", "created_at", "updated_at")} | {"status": text_of("status", "active"), "body": body}
    for name in ("id", *(["references"] if isinstance(fields.get("references"), list) else [])):
        for one in fields[name] if name == "references" else [out["id"]]:
            try:
                uuid.UUID(one)
            except ValueError:
                raise Malformed(f"{name}: no UUID") from None
    if out["type"] not in TYPES or out["status"] not in STATUSES:
        raise Malformed("unknown type or status")
    if isinstance(fields.get("volatility"), str) and fields["volatility"] not in VOLATILITIES:
        raise Malformed("unknown volatility")
    if not all(TIME.match(out[k]) and out[k][19:].lstrip(".0123456789") for k in ("created_at", "updated_at")):
        raise Malformed("no time with an offset")
    rest = {k: v for k, v in fields.items() if k not in COMMON}
    return out | {"refs": fields["references"] if isinstance(fields.get("references"), list) else [], "properties": {k: str(v).lower() if isinstance(v, bool) else serialise({"": v})[2:-1] if isinstance(v, list) else str(v) for k, v in rest.items()}}


def read_records(texts: DataFrame) -> DataFrame:
    """Records of texts (path, text): one row per text, `error` set and the rest null where it is malformed."""
    from hashlib import sha256

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"]):
                try:
                    out.append(record(text or "") | {"path": path, "content_hash": sha256((text or "").encode()).hexdigest(), "error": None})
                except Malformed as e:
                    out.append({"path": path, "error": str(e)})
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda x: x.notna(), None)

    return texts.select("path", "text").mapInPandas(run, SCHEMA)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all `*.md` files below a folder."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return read_records(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def sync(old: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, errors): what reading `files` (read_records) does to `old` (id, path, content_hash, status).

    Of files with one id the first by path counts, the others are errors. Changes: (id, path, change) with created, updated,
    skipped (same hash) or stale (its file is gone: no file of that path was read, not even a malformed one).
    """
    files = durable(files)
    good = files.where("error is null")
    first = good.groupBy("id").agg(F.min("path").alias("first"))
    twice = good.join(first, "id").where("path <> first").select("path", F.lit("id of another file").alias("error"))
    new = good.join(first, "id").where("path = first").select("id", F.col("path").alias("new_path"), F.col("content_hash").alias("new_hash"))
    both = new.join(old.select("id", "path", "content_hash", F.lit(1).alias("was")), "id", "left")
    change = F.when(F.col("was").isNull(), "created").when(F.col("content_hash") == F.col("new_hash"), "skipped").otherwise("updated")
    gone = old.where("path is not null and status = 'active'").join(files.select("path").distinct(), "path", "left_anti").join(new.select("id"), "id", "left_anti")
    changes = both.select("id", F.col("new_path").alias("path"), change.alias("change")).unionByName(gone.select("id", "path", F.lit("stale").alias("change")))
    return changes, files.where("error is not null").select("path", "error").unionByName(twice)
