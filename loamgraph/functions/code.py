"""Paths, names and hashes of source code, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source file extensions and their language.
LANGUAGES = {
    "rs": "rust", "py": "python", "go": "go", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "tsx", "sh": "bash", "bash": "bash",
}

# Path patterns of test files, in LIKE notation (`_` is a wildcard).
TEST_PATHS = [
    "tests/%", "%/tests/%", "%/tests.rs", "%_tests.rs", "%_test.go", "%/test_%.py", "%/_test.py", "%.test.js", "%.spec.js", "%.test.mjs", "%.spec.mjs", "%.test.cjs", "%.spec.cjs",
    "%.test.jsx", "%.spec.jsx", "%.test.ts", "%.spec.ts", "%.test.tsx", "%.spec.tsx", "%/__tests__/%", "%/test_%.sh", "%/_test.sh", "%/test_%.bash", "%/_test.bash",
]


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name; null without a dot."""
    ext = F.regexp_extract(path, r"\.([^./]*)\z", 1)
    return F.when(path.rlike(r"\.[^./]*\z"), ext)


def language(path: Column) -> Column:
    """Language of a source path, null for other files."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.create_map(*pairs)[F.coalesce(extension(path), F.lit(""))]


def is_test_file(path: Column) -> Column:
    """Whether a path is a test file by the conventions of its language; false for null and unknown languages."""
    ext, name = extension(path), F.regexp_extract(path, r"([^/]*)\z", 1)
    folder = path.startswith("tests/") | path.contains("/tests/")
    script = lambda e: name.rlike(rf"\Atest_.+\.{e}\z") | name.rlike(rf".+_test\.{e}\z")
    rule = (
        F.when(ext == "rs", folder | (path == "tests.rs") | path.endswith("/tests.rs") | path.endswith("_tests.rs"))
        .when(ext == "go", path.endswith("_test.go"))
        .when(ext == "py", folder | script("py"))
        .when(ext.isin("js", "mjs", "cjs", "jsx", "ts", "tsx"), path.contains("/__tests__/") | name.rlike(r".+\.(test|spec)\.[a-z]+\z"))
        .when(ext == "sh", script("sh"))
        .when(ext == "bash", script("bash"))
    )
    return F.coalesce(rule, F.lit(False))


def looks_like_test_path(path: Column) -> Column:
    """The LIKE form of the test path rule; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [path.like(p) for p in TEST_PATHS]), F.lit(False))


def is_identifier_shaped(name: Column) -> Column:
    """Whether a name is spelt as an identifier: snake_case, dotted or camelCase."""
    return name.contains("_") | name.contains(".") | name.rlike(r"\p{Ll}\p{Lu}")


def slug(title: Column, most: int = 60) -> Column:
    """Lower-case words joined by hyphens, cut at the last hyphen within `most` characters."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    head = F.substring(whole, 1, most)
    return F.when(F.length(whole) <= most, whole).when(head.contains("-"), F.regexp_replace(head, r"-[^-]*\z", "")).otherwise(head)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def name_uuid(text: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The version 5 UUID of a text in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 19, 2), F.lit("-"), F.substring(digest, 21, 12))


def snippet(text: Column, most: int = 120) -> Column:
    """Trimmed text on one line, cut to whole characters within `most` bytes, with an ellipsis if cut."""
    line = F.regexp_replace(F.trim(text), "\n", " ")
    sizes = F.sequence(F.lit(1), F.lit(most))
    cut = F.aggregate(sizes, F.lit(""), lambda best, n: F.when(F.octet_length(F.substring(line, F.lit(1), n)) <= most, F.substring(line, F.lit(1), n)).otherwise(best))
    return F.when(F.octet_length(line) <= most, line).otherwise(F.concat(cut, F.lit("…")))
