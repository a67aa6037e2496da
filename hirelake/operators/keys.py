"""Surrogate keys and dimension resolution without a single-task sort and without locking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.session import settle, shared_folder

COLLATION = "UNICODE_CI_AI"


def number_rows(written: DataFrame, id_col: str, start: int = 0) -> DataFrame:
    """Dense ids start+1, start+2, … in file and row order over a DataFrame that reads Parquet files.

    A row's id is its position in its file plus the sizes of the files before it. Positions come from the reader, so
    the data is not shuffled, and the ids stay the same however often a lost task is repeated. Only the file sizes,
    one row per file, go through a window.
    """
    marked = written.select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    sizes = marked.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    before = W.orderBy(part, "_file").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    numbered = marked.join(offsets, "_file")
    return numbered.withColumn(
        id_col, (F.lit(start) + F.col("_before") + F.col("_row") + 1).cast("long")
    ).drop("_file", "_row", "_before")


def sequential_ids(df: DataFrame, id_col: str, order_by, start: int = 0) -> DataFrame:
    """Dense ids in ``order_by`` order: a range-partitioned sort is written once, then numbered in place."""
    path = shared_folder(df.sparkSession, "ids")
    df.orderBy(*order_by).write.parquet(path)
    return number_rows(df.sparkSession.read.schema(df.schema).parquet(path), id_col, start)


def _folded(name: str, collation: str) -> Column:
    return F.collate(F.coalesce(F.col(name), F.lit("")), collation)


def _same_key(left: str, right: str, key_cols) -> Column:
    same = F.lit(True)
    for name in key_cols:
        same = same & (F.col(f"{left}._fold_{name}") == F.col(f"{right}._fold_{name}"))
        same = same & (F.col(f"{left}._none_{name}") == F.col(f"{right}._none_{name}"))
    return same


def _with_fold(df: DataFrame, key_cols, collation: str) -> DataFrame:
    """Folded text and a null mark per key column, so that plain equality is null-safe."""
    folds = [_folded(name, collation).alias(f"_fold_{name}") for name in key_cols]
    marks = [F.col(name).isNull().alias(f"_none_{name}") for name in key_cols]
    return df.select("*", *folds, *marks)


def spellings(df: DataFrame, key_cols, order_col: str, keep=()) -> DataFrame:
    """Distinct raw spellings with the place of their first occurrence (map-side combined, so hot keys are cheap)."""
    return df.groupBy(*key_cols).agg(
        F.min(order_col).alias("first_seen"), *[F.min_by(name, order_col).alias(name) for name in keep]
    )


def new_members(spelled: DataFrame, dim: DataFrame, key_cols, keep=(), collation: str = COLLATION) -> DataFrame:
    """Members that ``dim`` lacks: one row per folded key with its first spelling, ``keep`` columns and first place."""
    keys = [f"_fold_{name}" for name in key_cols] + [f"_none_{name}" for name in key_cols]
    known = _with_fold(dim.select(*key_cols), key_cols, collation).select(*keys).alias("known")
    fresh = _with_fold(spelled, key_cols, collation).alias("fresh")
    fresh = fresh.join(known, _same_key("fresh", "known", key_cols), "left_anti")
    first = F.struct("first_seen", *key_cols, *keep)
    return fresh.groupBy(*keys).agg(F.min_by(first, "first_seen").alias("_first")).select("_first.*")


def key_mapping(spelled: DataFrame, dim: DataFrame, key_cols, id_col: str, collation: str = COLLATION) -> DataFrame:
    """(raw spelling…, id): resolves each distinct spelling, so the fact table later joins on plain equality."""
    left = _with_fold(spelled.select(*key_cols), key_cols, collation).alias("fresh")
    right = _with_fold(dim.select(id_col, *key_cols), key_cols, collation).alias("known")
    return left.join(right, _same_key("fresh", "known", key_cols)).select(
        *[F.col(f"fresh.{name}") for name in key_cols], F.col(f"known.{id_col}")
    )


def resolve_dim(rows: DataFrame, dim: DataFrame, key_cols, id_col: str, order_col: str, keep=(),
                start: int | None = None, collation: str = COLLATION) -> tuple[DataFrame, DataFrame]:
    """Get-or-create: (new members with ids, mapping from every raw spelling to its id).

    Keys match ignoring case and accents, null equals null; the first spelling is kept and ids follow the order of
    first occurrence. ``dim`` needs ``id_col`` and ``key_cols``; ``start`` is its highest id if already known.
    The rows are read once, for their spellings. The mapping is a written table, so the planner knows its size: a
    small one is broadcast to the facts without shuffling them.
    """
    return resolve_spelled(settle(spellings(rows, key_cols, order_col, keep), "spellings"), dim, key_cols, id_col, keep, start, collation)


def resolve_spelled(spelled: DataFrame, dim: DataFrame, key_cols, id_col: str, keep=(), start: int | None = None,
                    collation: str = COLLATION) -> tuple[DataFrame, DataFrame]:
    """:func:`resolve_dim` for distinct spellings that were collected before (see :func:`spellings`)."""
    if start is None:
        start = dim.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    added = sequential_ids(new_members(spelled, dim, key_cols, keep, collation), id_col, ["first_seen"], start)
    added = added.select(id_col, *key_cols, *keep)
    mapping = key_mapping(spelled, dim.select(id_col, *key_cols).unionByName(added.select(id_col, *key_cols)),
                          key_cols, id_col, collation)
    return added, settle(mapping, "mapping")


def attach_id(rows: DataFrame, mapping: DataFrame, key_cols, how: str = "inner") -> DataFrame:
    """Null-safe lookup of the id of each row's raw spelling.

    No broadcast hint: the mapping grows with the number of members, so its size on disk decides, and a hot
    spelling on the sort-merge path is split by the adaptive skew join.
    """
    right = mapping.select(*[F.col(name).alias(f"_m_{name}") for name in key_cols],
                           *[name for name in mapping.columns if name not in key_cols])
    same = F.lit(True)
    for name in key_cols:
        same = same & F.col(name).eqNullSafe(F.col(f"_m_{name}"))
    return rows.join(right, same, how).drop(*[f"_m_{name}" for name in key_cols])


def insert_ignore(links: DataFrame, existing: DataFrame, keys=("job_id", "skill_id")) -> DataFrame:
    """New link rows only: duplicates within the batch and links that exist already are left out."""
    return links.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
