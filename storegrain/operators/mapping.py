"""Column names: API, table and model vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from storegrain import schemas


def _renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by ``mapping``; several sources of one target are coalesced in mapping order.

    A target that already exists keeps its values and takes the sources only where it is null.
    """
    sources: dict[str, list[str]] = {}
    for source, target in mapping.items():
        if source in df.columns:
            sources.setdefault(target, []).append(source)
    moved = {s for group in sources.values() for s in group}
    done, out = set(), []
    targets = {s: t for s, t in mapping.items() if s in moved}
    for name in df.columns:
        target = targets.get(name, name)
        if target in done:
            continue
        done.add(target)
        parts = [target] if target in df.columns and target not in moved else []
        parts += sources.get(target, [])
        out.append((F.coalesce(*parts) if len(parts) > 1 else F.col(parts[0])).alias(target))
    return df.select(*out)


def to_model_names(df: DataFrame) -> DataFrame:
    """API names, then table names, become model names; model names stay."""
    df = _renamed(df, schemas.API_TO_MODEL)
    fresh = {s: t for s, t in schemas.TABLE_TO_MODEL.items() if t not in df.columns}
    return _renamed(df, fresh)


def to_table_names(df: DataFrame) -> DataFrame:
    """API names become ``stores`` columns."""
    return _renamed(df, schemas.API_TO_TABLE)


def to_region_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({s: t for s, t in schemas.REGION_TO_TABLE.items() if s in df.columns})


def project(df: DataFrame, schema: T.StructType, leave_out=()) -> DataFrame:
    """The columns a table knows, in table order and with the table's types; values out of range become null."""
    out = []
    for field in schema.fields:
        if field.name not in df.columns or field.name in leave_out:
            continue
        column, kind = F.col(field.name), df.schema[field.name].dataType
        if isinstance(field.dataType, (T.LongType, T.IntegerType)):
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                column = F.round(column)
            elif isinstance(kind, T.StringType):
                # Text such as 1.5E8 is a whole number of money, too. It is no bigint: asking raises and drops an exception for every row.
                whole = F.when(~column.rlike("[.eE]"), column.try_cast("bigint"))
                column = F.coalesce(whole, F.round(column.try_cast("double")).try_cast("bigint"))
        out.append(column.try_cast(field.dataType).alias(field.name))
    return df.select(*out)


def fill_absent(df: DataFrame) -> DataFrame:
    """Model columns the frame does not have, as constants."""
    absent = {c: F.lit(v) for c, v in schemas.ABSENT_DEFAULTS.items() if c not in df.columns}
    for name, value in schemas.ABSENT_DEFAULTS.items():
        if name in absent and isinstance(value, int):
            absent[name] = F.lit(value).cast("bigint")
    return df.withColumns(absent) if absent else df


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
