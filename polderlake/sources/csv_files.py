"""CSV uploads: declared columns, strict types, constraints, audit columns, append to bronze."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.functions.streams import without_scheme
from polderlake.plans.staging import BILLING_COLUMNS
from polderlake.sources.tables import adopt_path, drop_path, pending_path, write_path

# Texts read as null, timestamp patterns in the order they are tried, boolean texts.
NULL_TEXTS = ("", "NULL", "null", "NA")
TIMESTAMP_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
)
TRUE_TEXTS = ("1", "true", "True", "TRUE")
FALSE_TEXTS = ("0", "false", "False", "FALSE")
SPARK_TYPES = {"varchar": "string", "integer": "bigint", "double": "double", "boolean": "boolean", "date": "date"}
NUMERIC_TYPES = ("integer", "double", "decimal")
_FILE = "_file"


@dataclass(frozen=True)
class CsvColumn:
    name: str
    type: str
    required: bool = True
    min: float | None = None
    max: float | None = None
    precision: int = 18
    scale: int = 6

    @property
    def spark_type(self) -> str:
        if self.type == "decimal":
            return f"decimal({self.precision},{self.scale})"
        if self.type == "timestamp":
            return "timestamp"
        if self.type not in SPARK_TYPES:
            raise ValueError(f"unknown column type {self.type!r} for column {self.name!r}")
        return SPARK_TYPES[self.type]


@dataclass(frozen=True)
class CsvFormat:
    delimiter: str = ","
    has_header: bool = True
    encoding: str = "utf-8"


def declared(name: str, spark_type: str, required: bool) -> CsvColumn:
    """A column from a Spark type, such as `decimal(18,6)`."""
    if spark_type.startswith("decimal"):
        precision, scale = (int(n) for n in spark_type[8:-1].split(","))
        return CsvColumn(name, "decimal", required, precision=precision, scale=scale)
    return CsvColumn(name, {"string": "varchar", "bigint": "integer"}.get(spark_type, spark_type), required)


def as_text(column: CsvColumn) -> Column:
    """How an upload writes a value of the column."""
    value = F.col(f"`{column.name}`")
    return F.date_format(value, TIMESTAMP_PATTERNS[3]) if column.type == "timestamp" else value.cast("string")


# The billing upload, by the columns that its staging declares.
BILLING_CSV = tuple(declared(*column) for column in BILLING_COLUMNS)


def _text(column: CsvColumn, raw: Column | None = None) -> Column:
    raw = F.col(f"`{column.name}`") if raw is None else raw
    return F.when(~raw.isin(*NULL_TEXTS), raw)


def _may_fit(text: Column, pattern: str) -> Column:
    """Whether the text has the letters and the fraction that the pattern asks for, in either case, as for the parser."""
    wanted = F.lit(True)
    if "'Z'" in pattern:
        wanted &= text.endswith("Z") | text.endswith("z")
    if "'T'" in pattern:
        wanted &= text.contains("T") | text.contains("t")
    return wanted & text.contains(".") if "." in pattern else wanted


def _timestamp(text: Column) -> Column:
    """The text by the one pattern that may fit: a try that fails is an exception, which takes longer than all else.

    A pattern comes before those that ask for less, so the first whose signs are there is the only one that can fit.
    """
    return reduce(
        lambda rest, pattern: F.when(_may_fit(text, pattern), F.try_to_timestamp(text, F.lit(pattern))).otherwise(rest),
        reversed(TIMESTAMP_PATTERNS),
        F.lit(None).cast("timestamp"),
    )


def _parsed(column: CsvColumn, raw: Column | None = None) -> Column:
    """The typed value, null when the text (by default that of the column's name) does not fit the type."""
    text, target = _text(column, raw), column.spark_type
    if column.type == "varchar":
        return text
    if column.type == "timestamp":
        raw = F.col(f"`{column.name}`") if raw is None else raw
        return F.when(~raw.isin(*NULL_TEXTS), _timestamp(raw))
    if column.type == "date":
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    if column.type == "boolean":
        return F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False)
    if column.type == "decimal":
        # More decimals than declared are an error, not rounded away.
        value = text.try_cast(target)
        return F.when(value == text.try_cast("decimal(38,18)"), value)
    return text.try_cast(target)


def typed_columns(raw: DataFrame, columns: Sequence[CsvColumn], strict: bool = True) -> DataFrame:
    """Text columns -> declared columns in declared order; other columns are dropped.

    A text that does not fit fails the job, or becomes null when not `strict`.
    """
    missing = [column.name for column in columns if column.name not in raw.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present: {raw.columns}")
    # Columns of one type are parsed as one array: written out for each column, the code of a wide upload is too long to be compiled.
    alike: dict[str, list[CsvColumn]] = {}
    for column in columns:
        alike.setdefault(column.spark_type, []).append(column)
    arrays, result = {}, {}
    for at, (spark_type, group) in enumerate(alike.items()):
        texts = F.array(*[F.col(f"`{column.name}`").cast("string") for column in group])
        arrays[f"_typed_{at}"] = F.transform(texts, _parser(group, strict))
        result |= {column.name: F.get(f"_typed_{at}", F.lit(i)).alias(column.name) for i, column in enumerate(group)}
    return raw.select(*[array.alias(name) for name, array in arrays.items()]).select(*[result[column.name] for column in columns])


def _parser(group: Sequence[CsvColumn], strict: bool) -> Callable[[Column, Column], Column]:
    """From a text and its place among the columns, which are of one type, to its value."""
    column = group[0]

    def parse(raw: Column, at: Column) -> Column:
        value = _parsed(column, raw)
        if not strict or column.type == "varchar":
            return value
        text = _text(column, raw)
        message = F.concat(F.lit("column "), F.get(F.array(*[F.lit(one.name) for one in group]), at), F.lit(f": not a {column.type}: "), text)
        return F.coalesce(value, F.when(text.isNotNull(), F.raise_error(message).cast(column.spark_type)))

    return parse


def _headers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file_path, header, header_2): 128 bits of hash of each file's first line.

    Numbers are aggregated as they come. The line itself would be found by a sort of all lines that are in a file's first
    block, which in a compressed file are all it has.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    hashes = {"header": F.xxhash64("value"), "header_2": F.xxhash64(F.lit(1), "value")}
    return lines.where("file_block_start = 0").groupBy("file_path").agg(*[F.min_by(value, "at").alias(name) for name, value in hashes.items()])


def files_by_header(spark: SparkSession, path: str | Sequence[str]) -> list[list[str]]:
    """The files of `path`, those with the same header line together. Files without a line are left out.

    Only the files' names reach the driver.
    """
    groups = _headers(spark, path).groupBy("header", "header_2").agg(F.sort_array(F.collect_list("file_path")).alias("files")).orderBy("files").collect()
    return [[unquote(file) for file in row.files] for row in groups]


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[CsvColumn],
    form: CsvFormat = CsvFormat(),
    strict: bool = True,
    file_column: str | None = None,
) -> DataFrame:
    """CSV files (or folders) by their declared columns.

    Columns are found by the header of their own file: files whose headers differ in order or in extra columns are read
    apart. `file_column` names a further column with the file's path.
    """
    reader = (
        spark.read.option("sep", form.delimiter)
        .option("encoding", form.encoding)
        .option("header", form.has_header)
        .option("multiLine", False)
        .option("escape", '"')
    )
    paths = [path] if isinstance(path, str) else list(path)

    def typed(raw: DataFrame) -> DataFrame:
        if file_column is None:
            return typed_columns(raw, columns, strict)
        named = raw.withColumn(_FILE, F.col("_metadata.file_path"))
        own = typed_columns(named, [*columns, CsvColumn(_FILE, "varchar")], strict)
        return own.withColumnRenamed(_FILE, file_column)

    if not form.has_header:
        return typed(reader.schema(", ".join(f"`{column.name}` string" for column in columns)).csv(paths))
    groups = files_by_header(spark, paths)
    if len(groups) <= 1:
        return typed(reader.csv(paths))
    return reduce(DataFrame.unionByName, [typed(reader.csv(files)) for files in groups])


# ---- one permissive parse: every line is kept, with what is wrong with it -----------------------------------

REASONS, LINE = "refused_for", "line"


def _fields(line: Column, form: CsvFormat, width: int) -> Column:
    """The texts of one line's fields, as an array of `width`."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.from_csv(line, schema, {"sep": form.delimiter, "escape": '"', "mode": "PERMISSIVE"})
    return F.array(*[parsed[f"c{i}"] for i in range(width)])


def _width(line: Column, form: CsvFormat) -> Column:
    """The number of fields: separators outside of quotes, and one."""
    bare = F.regexp_replace(line, '"([^"]|"")*"', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(form.delimiter), F.lit("")))) / len(form.delimiter) + 1


def _reasons(columns: Sequence[CsvColumn]) -> Column:
    """What is wrong with a line, from its texts (`_text_<i>`) and typed values.

    With another number of fields than its header a line is refused for that alone: what stands where is not known.
    """
    found = []
    for i, column in enumerate(columns):
        text, value = F.col(f"_text_{i}"), F.col(f"`{column.name}`")
        there = text.isNotNull() & ~text.isin(*NULL_TEXTS)
        found.append(F.when(~F.col(f"_present_{i}"), F.lit(f"missing:{column.name}")))
        found.append(F.when(there & value.isNull(), F.lit(f"type:{column.name}")))
        if column.required:
            found.append(F.when(~there & F.col(f"_present_{i}"), F.lit(f"required:{column.name}")))
        if column.type in NUMERIC_TYPES and column.min is not None:
            found.append(F.when(value < column.min, F.lit(f"min:{column.name}")))
        if column.type in NUMERIC_TYPES and column.max is not None:
            found.append(F.when(value > column.max, F.lit(f"max:{column.name}")))
    broken = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return F.when(F.col("_width") != F.col("_expected"), F.array(F.lit("fields"))).otherwise(broken)


def lines_of_files(spark: SparkSession, paths: Sequence[str], form: CsvFormat = CsvFormat()) -> DataFrame:
    """(source_file, block, at, line): all lines of the files, with what tells a file's first one."""
    lines = spark.read.option("encoding", form.encoding).text(list(paths))
    return lines.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias(LINE),
    )


def judged_lines(lines: DataFrame, columns: Sequence[CsvColumn], form: CsvFormat = CsvFormat()) -> DataFrame:
    """The declared columns, the line, its file, and the reasons for which it is refused (an empty array if for none).

    `lines` are those of `lines_of_files`, stored: the headers are read from them first, and the lines are parsed once,
    each by the header of its own file. A file without a line below its header gives one row without a line, refused as
    `non_empty`. Empty lines are passed over. The headers are as many rows as there are files.
    """
    own = lines.where(F.trim(F.regexp_replace(LINE, "[\\r\ufeff]", "")) != "")
    clean = own.withColumn(LINE, F.regexp_replace(LINE, "^\ufeff|\\r$", ""))
    first = clean.groupBy("source_file").agg(F.min_by(F.struct("at", LINE), F.struct("block", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    if form.has_header:
        widest = first.agg(F.max(_width(F.col(f"first.{LINE}"), form))).first()[0]
        width = max(int(widest or 1), len(columns))
        heads = first.select(
            F.col("source_file").alias("_file"),
            F.col("first.at").alias("_head_at"),
            F.transform(_fields(F.col(f"first.{LINE}"), form, width), lambda x: F.trim(x)).alias("_head"),
            _width(F.col(f"first.{LINE}"), form).alias("_expected"),
        )
        lone = first.where("n = 1")
    else:
        width = len(columns)
        heads = first.select(F.col("source_file").alias("_file"), F.lit(-1).cast("long").alias("_head_at"), F.array(*[F.lit(c.name) for c in columns]).alias("_head"), F.lit(float(width)).alias("_expected"))
        lone = first.limit(0)
    body = clean.join(F.broadcast(heads), F.col("source_file") == F.col("_file")).where(F.col("at") != F.col("_head_at"))
    split = body.select("source_file", LINE, "_head", "_expected", _fields(F.col(LINE), form, width).alias("_fields"), _width(F.col(LINE), form).alias("_width"))
    placed = split.select("*", *[F.array_position("_head", F.lit(c.name)).alias(f"_at_{i}") for i, c in enumerate(columns)])
    texts = placed.select(
        "source_file", LINE, "_expected", "_width",
        *[(F.col(f"_at_{i}") > 0).alias(f"_present_{i}") for i in range(len(columns))],
        *[F.when(F.col(f"_at_{i}") > 0, F.get("_fields", (F.col(f"_at_{i}") - 1).cast("int"))).alias(f"_text_{i}") for i in range(len(columns))],
    )
    typed = texts.select("*", *[_parsed(c, F.col(f"_text_{i}")).alias(c.name) for i, c in enumerate(columns)])
    judged = typed.select(*[F.col(f"`{c.name}`") for c in columns], LINE, "source_file", _reasons(columns).alias(REASONS))
    without = lone.select(
        *[F.lit(None).cast(c.spark_type).alias(c.name) for c in columns], F.lit(None).cast("string").alias(LINE), "source_file", F.array(F.lit("non_empty")).alias(REASONS)
    )
    return judged.unionByName(without)


def _rule_counts(columns: Sequence[CsvColumn]) -> dict[str, Column]:
    counts = {"non_empty": F.when(F.count(F.lit(1)) == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")}
    for column in columns:
        value = F.col(f"`{column.name}`")
        if column.required:
            counts[f"required:{column.name}"] = F.count_if(value.isNull())
        if column.type in NUMERIC_TYPES and column.min is not None:
            counts[f"min:{column.name}"] = F.count_if(value < column.min)
        if column.type in NUMERIC_TYPES and column.max is not None:
            counts[f"max:{column.name}"] = F.count_if(value > column.max)
    return counts


def constraint_report(df: DataFrame, columns: Sequence[CsvColumn]) -> DataFrame:
    """(rule, n_violations) for non-empty, required, min and max rules, from one aggregate."""
    counts = _rule_counts(columns)
    one_row = df.agg(*[count.alias(rule) for rule, count in counts.items()])
    return one_row.unpivot([], list(counts), "rule", "n_violations")


def assert_constraints(df: DataFrame, columns: Sequence[CsvColumn]) -> None:
    """Raise with all broken rules. The report has one row per rule, so collecting it is safe."""
    broken = constraint_report(df, columns).filter("n_violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{row.rule}: {row.n_violations}" for row in broken))


def assert_file_constraints(df: DataFrame, columns: Sequence[CsvColumn], file_column: str, paths: Sequence[str]) -> None:
    """Raise with the rules that single files break. One aggregate over all files; a file without rows is empty."""
    counts = _rule_counts(columns)
    by_file = df.groupBy(file_column).agg(*[count.alias(rule) for rule, count in counts.items()])
    rows = by_file.unpivot(file_column, list(counts), "rule", "n_violations").collect()
    seen = {without_scheme(unquote(row[file_column])) for row in rows}
    broken = [f"{unquote(row[file_column])}: {row.rule}: {row.n_violations}" for row in rows if row.n_violations > 0]
    broken += [f"{path}: non_empty: 1" for path in paths if without_scheme(path) not in seen]
    if broken:
        raise ValueError("; ".join(sorted(broken)))


def add_audit_columns(
    df: DataFrame, source_file: str | Column, partition_column: str = "event_date", now: datetime | None = None
) -> DataFrame:
    """Ingestion time, source file and, unless present, the load date."""
    at = F.current_timestamp() if now is None else F.lit(now)
    added = {
        "ingestion_ts": at,
        "source_file": source_file if isinstance(source_file, Column) else F.lit(source_file),
    }
    if partition_column not in df.columns:
        added[partition_column] = at.cast("date")
    return df.withColumns(added)


def append_bronze(df: DataFrame, path: str, partition_column: str = "event_date", file_format: str = "parquet") -> None:
    write_path(df, path, "append", [partition_column], file_format)


def within_prefix(path: str, prefix: str) -> bool:
    """Only files below the expected prefix may be ingested."""
    return path.startswith(prefix.rstrip("/") + "/")


def ingest_csv(
    spark: SparkSession,
    path: str,
    prefix: str,
    columns: Sequence[CsvColumn],
    bronze_path: str,
    form: CsvFormat = CsvFormat(),
    partition_column: str = "event_date",
    load_date: date | None = None,
) -> None:
    """One upload from file to bronze: guard, read, check, add audit columns, append.

    The rows are written once, aside in bronze where readers pass them over, so that texts are parsed once. They are
    checked there, and join the table if they keep all rules.
    """
    if not within_prefix(path, prefix):
        raise ValueError(f"{path!r} is not below {prefix!r}")
    audited = add_audit_columns(read_csv(spark, path, columns, form), path, partition_column)
    if load_date is not None:
        audited = audited.withColumn(partition_column, F.lit(load_date))
    pending = pending_path(bronze_path)
    try:
        append_bronze(audited, pending, partition_column)
        assert_constraints(spark.read.schema(audited.schema).parquet(pending), columns)
        adopt_path(spark, pending, bronze_path)
    finally:
        drop_path(spark, pending)
