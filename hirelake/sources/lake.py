"""Raw lake → records. A record is a map from folded key to JSON value, so absent and null stay different."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake import rules
from hirelake.functions.text import let_sql, quoted, strip, strip_sql
from hirelake.sources.manifest import Files

#: Names of the files that a lake folder is read for.
JSON_FILES, CSV_FILES = "*.[jJ][sS][oO][nN]", "*.[cC][sS][vV]"
LAKE_FILES = f"{{{JSON_FILES},{CSV_FILES}}}"
RECORD_COLUMNS = ("file", "ordinal", "fields", "raw")


def format_of(path: str) -> str:
    """'json' for a .json suffix in any case, otherwise 'csv'."""
    return "json" if path.lower().endswith(".json") else "csv"


def field_sql(name: str, fields: str = "fields") -> str:
    return f"try_element_at({fields}, {quoted(name)})"


def has_field_sql(name: str, fields: str = "fields") -> str:
    return f"coalesce(map_contains_key({fields}, {quoted(name)}), false)"


def field(name: str, fields: str = "fields") -> Column:
    """Value (variant) of a folded key; null if it is absent."""
    return F.expr(field_sql(name, fields))


def has_field(name: str, fields: str = "fields") -> Column:
    return F.expr(has_field_sql(name, fields))


def _folded_sql(entries: str) -> str:
    """map<string, variant> of array<struct(key, value)>: of several entries with one key the last counts. Only a record
    that repeats a key pays for finding out which entry that is."""
    later = "exists(slice(f, i + 2, size(f)), l -> l.key = e.key)"
    return let_sql(entries, "f", f"CASE WHEN size(array_distinct(f.key)) = size(f) THEN map_from_entries(f) "
                                 f"ELSE map_from_entries(filter(f, (e, i) -> NOT {later})) END")


def _within_sql(text: str, schema: str) -> str:
    """``text`` read as member v of an object that goes on behind it: the mark e is lost unless ``text`` is exactly one
    JSON value. The JSON functions by themselves take the first value and ignore what follows."""
    return f"from_json(concat('{{\"v\":', {text}, ',\"e\":1}}'), '{schema}e int')"


def record_fields(record_json: str) -> Column:
    """map<string, variant> of one JSON object with trimmed, lower-cased keys, the last of equal keys winning; null if
    the text is anything else than one whole object. The text is parsed once."""
    entry = f"named_struct('key', lower({strip_sql('e.key')}), 'value', e.value)"
    read = let_sql(_within_sql(record_json, "v map<string,variant>, "), "r", "CASE WHEN r.e = 1 THEN map_entries(r.v) END")
    return F.expr(_folded_sql(f"transform({read}, e -> {entry})"))


def document_records(document: str, envelope_keys=rules.ENVELOPE_KEYS) -> Column:
    """array<string> with the text of every record of a document (SQL text for a string).

    A whole JSON value: an array is its own list; an object gives the first envelope key that holds a list, else it is
    one record, as is any other value. Text that is not one value, does not begin as an array and has a line with an
    object of its own (JSON Lines under a .json name, as Spark's writer makes them) gives every line that is not blank:
    a broken line is a record by itself, and takes no other with it. Any other text is one record, which cannot be read.
    """
    envelope = f"from_json(d, {quoted(', '.join(f'`{key}` array<string>' for key in envelope_keys))})"
    lists = ", ".join(["from_json(d, 'array<string>')", *(f"{let_sql(envelope, 'o', f'o.`{key}`')}" for key in envelope_keys), "array(d)"])
    lines = "filter(split(d, '\\r?\\n', -1), l -> trim(l) <> '')"
    is_object = f"startswith(l, '{{') AND {_within_sql('l', '')}.e = 1"
    by_line = let_sql(lines, "ls", f"CASE WHEN size(ls) > 1 AND exists(ls, l -> {is_object}) THEN ls ELSE array(d) END")
    return F.expr(let_sql(document, "d", f"CASE WHEN {_within_sql('d', '')}.e = 1 THEN coalesce({lists}) "
                                         f"WHEN startswith({strip_sql('d')}, '[') THEN array(d) ELSE {by_line} END"))


def explode_documents(df: DataFrame, document: str = "value", file: str = "file",
                      envelope_keys=rules.ENVELOPE_KEYS) -> DataFrame:
    """(file, ordinal, fields, raw): one row per record of every document, ``ordinal`` counting from 0."""
    listed = df.select(F.col(file).alias("file"), document_records(f"`{document}`", envelope_keys).alias("records"))
    exploded = listed.select("file", F.posexplode_outer("records").alias("ordinal", "record"))
    return exploded.filter(F.col("ordinal").isNotNull()).select(
        "file", F.col("ordinal").cast("long").alias("ordinal"), record_fields("record").alias("fields"), F.col("record").alias("raw")
    )


def line_records(df: DataFrame, line: str = "value", file: str = "file") -> DataFrame:
    """(file, ordinal, fields, raw) for JSON Lines; ``ordinal`` rises within a file but is not dense."""
    return df.filter(strip(line) != "").select(
        F.col(file).alias("file"),
        F.monotonically_increasing_id().alias("ordinal"),
        record_fields(line).alias("fields"),
        F.col(line).alias("raw"),
    )


def csv_records(df: DataFrame, names, file: str = "file") -> DataFrame:
    """(file, ordinal, fields, raw) for CSV rows: every value is text, an empty cell is an empty text; ``raw`` is the row
    as a JSON object."""
    cells = [F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name) for name in names]
    entries = ", ".join(f"named_struct('key', lower({strip_sql(quoted(name))}), 'value', cast(coalesce(`{name}`, '') AS variant))" for name in names)
    return df.select(F.col(file).alias("file"), F.monotonically_increasing_id().alias("ordinal"),
                     F.expr(_folded_sql(f"array({entries})")).alias("fields"), F.to_json(F.struct(*cells)).alias("raw"))


def _read_csv(spark: SparkSession, paths: list[str], **options) -> list[DataFrame]:
    """Records of CSV files, each file by its own header: files are read together where their header lines are equal."""
    origin = F.col("_metadata.file_path").alias("file")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.options(**options).text(paths).select("value", origin, place.alias("place"))
    firsts = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    headers = [r["header"] for r in firsts.select("header").distinct().collect()]

    def records(files: list[str], **more) -> DataFrame:
        rows = spark.read.options(**more).csv(files, header=True, multiLine=True, escape='"', inferSchema=False, encoding="UTF-8")
        return csv_records(rows.select("*", origin), rows.columns)

    if len(headers) == 1:
        return [records(paths, **options)]
    return [records([r["file"] for r in firsts.filter(F.col("header") == header).select("file").collect()]) for header in sorted(headers)]


def _united(parts: list[DataFrame]) -> DataFrame:
    out, *rest = parts
    for part in rest:
        out = out.unionByName(part)
    return out


def read_lake(spark: SparkSession, path, fmt: str | None = None) -> DataFrame:
    """Records of a file, a folder or a list of paths.

    ``fmt``: ``json`` (a document, or JSON Lines, per file), ``lines`` (JSON Lines: splittable, the form our own sink
    writes) or ``csv`` (header, quoted line breaks allowed, each file by its own header). Without it the suffix of each
    file decides: .json or else CSV; in a folder, at any depth, files ending in .json and in .csv are read. What is a
    folder the file system says, whatever its name.
    """
    paths = [path] if isinstance(path, str) else list(path)
    origin = F.col("_metadata.file_path").alias("file")
    if fmt is None:
        folders = [p for p in paths if Files(spark, p).is_folder(p)]
        files = [p for p in paths if p not in folders]
        parts = []
        for kind, glob in (("json", JSON_FILES), ("csv", CSV_FILES)):
            own, options = [p for p in files if format_of(p) == kind], {"pathGlobFilter": glob, "recursiveFileLookup": "true"}
            if own:
                parts.append(read_lake(spark, own, kind))
            if folders and kind == "json":
                parts.append(explode_documents(spark.read.options(**options).text(folders, wholetext=True).select("value", origin)))
            elif folders:
                parts += _read_csv(spark, folders, **options)
        return _united(parts)
    if fmt == "json":
        return explode_documents(spark.read.text(paths, wholetext=True).select("value", origin))
    if fmt == "lines":
        return line_records(spark.read.text(paths).select("value", origin))
    if fmt != "csv":
        raise ValueError(f"unknown lake format {fmt!r}")
    return _united(_read_csv(spark, paths))
