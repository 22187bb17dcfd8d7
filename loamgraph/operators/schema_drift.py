"""JSON objects whose fields come, go, are renamed or change type from one file to the next.

Rows are loaded as (path, type, value) with the raw JSON types, path-type statistics are aggregated per file, and typed
columns are projected from them; values that do not fit their column are reported.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import durable

CHANGES = "record_table string, kind string, export_file string, field string, old_field string, change string"
SCALARS = ("string", "number", "boolean")


def json_type(value: Column) -> Column:
    """string, number, boolean, array or object of a VARIANT; null for JSON null and no value."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.isNull() | (kind == "VOID"), F.lit(None))
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def json_objects(df: DataFrame, table: str, kind: Column, text: str, file: str, *keys: Column) -> DataFrame:
    """Rows (record_table, kind, export_file, doc) whose text is a JSON object, with `keys`; all other texts count as no row.

    Rows without kind or file belong to no series and are left out.
    """
    rows = df.select(F.lit(table).alias("record_table"), kind.alias("kind"), F.col(file).alias("export_file"), *keys, F.try_parse_json(F.col(text)).alias("doc"))
    return rows.where(F.col("kind").isNotNull() & F.col("export_file").isNotNull() & F.schema_of_variant("doc").startswith("OBJECT"))


def path_values(objects: DataFrame, *keys: str) -> DataFrame:
    """One row per object and top-level path: field, json_type (null for JSON null) and the VARIANT value, with `keys`.

    An empty object gives one row with a null field, so that it still counts as a row of its file.
    """
    spark = objects.sparkSession
    pairs = spark.tvf.variant_explode_outer(F.col("doc").outer())
    flat = objects.lateralJoin(pairs)
    return flat.select("record_table", "kind", "export_file", *keys, F.col("key").alias("field"), json_type(F.col("value")).alias("json_type"), "value")


def path_statistics(values: DataFrame) -> DataFrame:
    """Rows per (record_table, kind, export_file, field, json_type)."""
    return values.groupBy("record_table", "kind", "export_file", "field", "json_type").agg(F.count("*").alias("n"))


def _steps(stats: DataFrame) -> DataFrame:
    """Every field that changes between a file and the one before it: old_file, old_types, new_types (null: not held)."""
    series = ["record_table", "kind"]
    files = stats.select(*series, "export_file").distinct()
    files = files.withColumn("old_file", F.lag("export_file").over(Window.partitionBy(*series).orderBy("export_file"))).where("old_file is not null")
    held = stats.where("field is not null and json_type is not null").groupBy(*series, "export_file", "field").agg(F.array_join(F.array_sort(F.collect_set("json_type")), ",").alias("types"))
    new = files.join(held, [*series, "export_file"]).select(*series, "export_file", "old_file", "field", F.col("types").alias("new_types"))
    old = files.join(held.withColumnRenamed("export_file", "old_file"), [*series, "old_file"]).select(*series, "export_file", "old_file", "field", F.col("types").alias("old_types"))
    both = new.join(old, [*series, "export_file", "old_file", "field"], "full_outer")
    return both.where(~F.col("new_types").eqNullSafe(F.col("old_types")))


def _renamings(objects: DataFrame, steps: DataFrame) -> DataFrame:
    """Pairs (old_field, field) of a step with the share of the added field's distinct values that the removed one had.

    Only fields that can take part in a renaming are read again. Pairs arise from the values they share, so fields without a
    common value never meet, however many come and go in one step.
    """
    series = ["record_table", "kind", "export_file"]
    single = F.col("types").isin(*SCALARS)
    gone = steps.where("new_types is null").select(*series, "old_file", F.col("field").alias("old_field"), F.col("old_types").alias("types")).where(single)
    came = steps.where("old_types is null").select(*series, F.col("field"), F.col("new_types").alias("types")).where(single)
    both = came.select(*series, "types").distinct().join(gone.select(*series, "types").distinct(), [*series, "types"])
    gone, came = durable(gone.join(both, [*series, "types"], "left_semi")), durable(came.join(both, [*series, "types"], "left_semi"))
    looked = gone.select("record_table", "kind", F.col("old_file").alias("export_file"), F.col("old_field").alias("field")).unionByName(came.select(*series, "field")).distinct()
    wanted = looked.select(*series).distinct()
    text = path_values(objects.join(wanted, series, "left_semi")).join(looked, [*series, "field"], "left_semi")
    text = text.where("json_type is not null").select(*series, "field", F.col("value").cast("string").alias("text")).distinct()
    added = text.join(came, [*series, "field"])
    n = added.groupBy(*series, "field").agg(F.count("*").alias("n"))
    removed = text.select("record_table", "kind", F.col("export_file").alias("old_file"), F.col("field").alias("old_field"), "text").join(gone, ["record_table", "kind", "old_file", "old_field"])
    hits = added.join(removed, [*series, "types", "text"]).groupBy(*series, "old_field", "field").agg(F.count("*").alias("hits"))
    share = hits.join(n, [*series, "field"]).select(*series, "old_field", "field", (F.col("hits") / F.col("n")).alias("share"))
    return share.where("share >= 0.5")


def _assign(step: pd.DataFrame) -> pd.DataFrame:
    """The changes of one step: best renamings first, each field once, then what is left."""
    key = step[["record_table", "kind", "export_file"]].iloc[0].tolist()
    out, used = [], set()
    pairs = step[step["share"].notna()].sort_values(["share", "old_field", "field"], ascending=[False, True, True])
    for old, new in zip(pairs["old_field"], pairs["field"]):
        if ("old", old) not in used and ("new", new) not in used:
            used |= {("old", old), ("new", new)}
            out.append([*key, new, old, "renamed"])
    for _, r in step[step["share"].isna()].iterrows():
        change = "retyped" if r["new_types"] and r["old_types"] else "added" if r["new_types"] else "removed"
        if not (change == "added" and ("new", r["field"]) in used or change == "removed" and ("old", r["field"]) in used):
            out.append([*key, r["field"], "", change])
    return pd.DataFrame(out, columns=["record_table", "kind", "export_file", "field", "old_field", "change"])


def schema_changes(objects: DataFrame) -> DataFrame:
    """Changes from each file to the next, per (record_table, kind), in the order of the files' names.

    `added`, `removed`, `retyped` (another set of JSON types), `renamed` (a removed and an added field with the same single
    scalar type, at least half of whose new distinct values the old field had in the file before). A kind that occurs in
    one file only has no changes; an empty table has none. Statistics, steps and candidate pairs are as large as the schemas;
    their lineage is cut, so the plans stay small.
    """
    stats = durable(path_statistics(path_values(objects)))
    steps = durable(_steps(stats))
    none = F.lit(None)
    plain = steps.select("record_table", "kind", "export_file", "field", none.cast("string").alias("old_field"), "new_types", "old_types", none.cast("double").alias("share"))
    renamed = _renamings(objects, steps).select("record_table", "kind", "export_file", "field", "old_field", none.cast("string").alias("new_types"), none.cast("string").alias("old_types"), "share")
    return plain.unionByName(renamed).groupBy("record_table", "kind", "export_file").applyInPandas(_assign, CHANGES)


NAMES = "record_table string, kind string, export_file string, field string, column string"


def column_names(stats: DataFrame, changes: DataFrame) -> DataFrame:
    """(record_table, kind, export_file, field, column): the column that a field of a file belongs to. A field that is renamed
    in a later file belongs to its successor's column, through any number of renamings; all others to their own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = sorted(pdf[pdf["old_field"].notna()][["export_file", "old_field", "field"]].itertuples(index=False, name=None))
        later: dict[str, list] = {}
        for file, old, new in steps:
            later.setdefault(old, []).append((file, new))
        held = pdf[pdf["old_field"].isna()]
        names = []
        for file, name in zip(held["export_file"], held["field"]):
            while step := next(((f, new) for f, new in later.get(name, []) if f > file), None):
                file, name = step
            names.append(name)
        return held[["record_table", "kind", "export_file", "field"]].assign(column=names)

    none = F.lit(None).cast("string").alias("old_field")
    fields = stats.where("field is not null").select("record_table", "kind", "export_file", "field", none).distinct()
    renamed = changes.where("change = 'renamed'").select("record_table", "kind", "export_file", "field", "old_field")
    return fields.unionByName(renamed).groupBy("record_table", "kind").applyInPandas(run, NAMES)


def typed_columns(stats: DataFrame) -> DataFrame:
    """The column type of every field of a kind: its most frequent JSON type over all files (ties by name)."""
    total = stats.where("field is not null and json_type is not null").groupBy("record_table", "kind", "field", "json_type").agg(F.sum("n").alias("n"))
    return total.groupBy("record_table", "kind", "field").agg(F.max_by("json_type", F.struct("n", "json_type")).alias("column_type"))


def _fits() -> Column:
    """Whether a value can be cast to its column's type."""
    return (
        F.when(F.col("column_type") == "string", True)
        .when(F.col("column_type") == "number", F.try_variant_get("value", "$", "double").isNotNull())
        .when(F.col("column_type") == "boolean", F.try_variant_get("value", "$", "boolean").isNotNull())
        .otherwise(F.col("json_type") == F.col("column_type"))
    )


def typed_values(objects: DataFrame) -> DataFrame:
    """Per field and file the numbers of rows that fit the field's column type and of those that do not.

    A value fits if it can be cast: numbers and booleans from their texts too, anything to string; arrays and objects only
    from themselves.
    """
    values = path_values(objects).where("field is not null and json_type is not null")
    types = typed_columns(path_statistics(values))
    rows = values.join(types, ["record_table", "kind", "field"])
    return rows.groupBy("record_table", "kind", "export_file", "field", "column_type").agg(
        F.count("*").alias("n_rows"), F.sum(F.when(_fits(), 0).otherwise(1)).alias("n_failed_casts")
    )


def typed_table(objects: DataFrame, stats: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """One consistent long table of all kinds: one row per object, named by `keys`, and field, under the field's column and in
    the column's type.

    A field that was renamed later stands under its successor's column (`names`, of column_names). Of string_value,
    number_value, boolean_value and json_value (arrays and objects as JSON) the one of the type holds the value. One that does
    not fit leaves all four null, sets failed_cast and stays in raw_value as JSON. JSON null is null; an empty object gives
    one row without a field. `stats` are the path statistics of the objects; names and types are as large as the schemas.
    """
    at = ["record_table", "kind", "export_file", "field"]
    names = durable(names)
    folded = stats.join(names, at).withColumn("field", F.col("column")).drop("column")
    types = typed_columns(folded).withColumnRenamed("field", "column")
    known = durable(names.join(types, ["record_table", "kind", "column"], "left"))
    rows = path_values(objects, *keys).join(known, at, "left")
    held = F.col("json_type").isNotNull()
    rows = rows.withColumn("failed_cast", held & ~_fits())
    of = lambda *kinds: held & F.col("column_type").isin(*kinds) & ~F.col("failed_cast")
    text = F.when(F.col("json_type").isin("array", "object"), F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string"))
    return rows.select(
        *at, "column", *keys, "column_type",
        F.when(of("string"), text).alias("string_value"), F.when(of("number"), F.try_variant_get("value", "$", "double")).alias("number_value"),
        F.when(of("boolean"), F.try_variant_get("value", "$", "boolean")).alias("boolean_value"), F.when(of("array", "object"), F.to_json("value")).alias("json_value"),
        F.coalesce("failed_cast", F.lit(False)).alias("failed_cast"), F.when(F.col("failed_cast"), F.to_json("value")).alias("raw_value"),
    )
