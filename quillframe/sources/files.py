"""Uploaded files as rows: admission, encoding fallback, parsing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import fixed_values as V
from quillframe.sources.csv_records import cells, column_names, records_of
from quillframe.sources.tables import null_if_missing, typed

_MB = 1024 * 1024
# Parts of a scan of files that one task reads.
SCAN_PARTS = 32
# Each byte from 0x80 on as Latin-1 and as cp1251 read it.
_HIGH = [b for b in range(0x80, 0x100) if b != 0x98]
_AS_LATIN = "".join(chr(b) for b in _HIGH)
_AS_CP1251 = bytes(_HIGH).decode("cp1251")


def encoding_of(content: Column) -> Column:
    """First encoding, in the order tried, that decodes the whole content.

    cp1251 leaves one byte undefined; Latin-1 takes everything.
    """
    utf8, cp1251, latin = V.ENCODINGS
    # Single-byte text, so a character stands for a byte.
    undefined = F.decode(content, "ISO-8859-1").contains(F.lit("\x98"))
    return (
        F.when(F.is_valid_utf8(content.cast("string")), F.lit(utf8))
        .when(~undefined, F.lit(cp1251))
        .otherwise(F.lit(latin))
    )


def decoded(content: Column, encoding: Column) -> Column:
    utf8, cp1251, _ = V.ENCODINGS
    single = F.decode(content, "ISO-8859-1")
    return (
        F.when(encoding == utf8, content.cast("string"))
        .when(encoding == cp1251, F.translate(single, _AS_LATIN, _AS_CP1251))
        .otherwise(single)
    )


def with_decoded_text(df: DataFrame, content: str = "content") -> DataFrame:
    """Replace the bytes by ``encoding`` and ``text``."""
    found = df.withColumn("encoding", encoding_of(F.col(content)))
    return found.withColumn("text", decoded(F.col(content), F.col("encoding"))).drop(content)


def has_table_extension(path: Column) -> Column:
    matches = [path.endswith(F.lit(e)) for e in V.TABLE_EXTENSIONS]
    return matches[0] | matches[1] | matches[2]


def admission_reason(
    path: Column, length: Column, readable: Column, rows: Column, max_mb: int = V.MAX_FILE_MB
) -> Column:
    """The first rule a file breaks, in order; NULL for an admitted file."""
    before, rest = V.REJECT_SIZE.replace("{limit}", str(max_mb)).split("{size}")
    # Ties go to the even digit, as in C and Python formatting.
    size = F.format_string("%.1f", F.bround(length / _MB, 1))
    return (
        F.when(~has_table_extension(path), F.lit(V.REJECT_EXTENSION))
        .when(length > max_mb * _MB, F.concat(F.lit(before), size, F.lit(rest)))
        .when(~readable, F.lit(V.REJECT_READ))
        .when(rows == 0, F.lit(V.REJECT_EMPTY))
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, content)``; content is only read where it is used."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def write_files(rows: DataFrame, path: str) -> None:
    """Write each row of ``(name, content)`` as a file of that name below ``path``, in parallel.

    Any store that Arrow's file systems reach will do. A task that runs again writes the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        done = 0
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content.as_py())
                done += 1
        yield pa.RecordBatch.from_pydict({"done": pa.array([done], pa.int64())})

    rows.select("name", "content").mapInArrow(run, "done long").agg(F.sum("done")).collect()


def encoded_cp1251(text: Column) -> Column:
    """The bytes of a text in cp1251; characters that it lacks become question marks."""
    return F.encode(F.translate(text, _AS_CP1251, _AS_LATIN), "ISO-8859-1")


def _parsed(max_mb: int) -> Column:
    """Which files are parsed, by path and length."""
    fits = has_table_extension(F.col("path")) & (F.col("length") <= max_mb * _MB)
    return fits & F.col("path").endswith(F.lit(V.TABLE_EXTENSIONS[0]))


def _in_fewer_tasks(df: DataFrame) -> DataFrame:
    """A scan of files, ``SCAN_PARTS`` of the reader's parts a task; the reader puts but some thirty small files in one.

    There stay four tasks a core at least, where there are as many parts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(4 * cores, df._jdf.rdd().getNumPartitions() // SCAN_PARTS))


def _listed(files: DataFrame) -> DataFrame:
    """``(path, length)`` of all files below the path, those without any byte among them."""
    spark = files.sparkSession
    # The reader leaves files of no length out; the listing has them, with escapes. It goes to tasks without passing Python.
    jvm = spark._jvm
    names = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles())
    names = jvm.scala.jdk.javaapi.CollectionConverters.asJava(names)
    names = DataFrame(spark._jsparkSession.createDataset(names, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    plain = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))
    names = names.select(F.regexp_replace(plain, r"^(\w+):///", "$1:/").alias("path"), F.lit(0).cast("long").alias("length"))
    every = names.unionByName(_in_fewer_tasks(files.select("path", "length")))
    return every.groupBy("path").agg(F.max("length").alias("length"))


def _decoded(content: bytes) -> tuple[str, str]:
    """(encoding, text): the first encoding, in the order tried, that takes the whole content."""
    for encoding in V.ENCODINGS:
        try:
            return encoding, content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


def parse_table(content: bytes, sep: str = ",") -> tuple[str, list[str], list[list[str]]]:
    """(encoding, column names, rows) of a CSV file's bytes; ValueError where it cannot be read.

    A file is not readable without a header, with a row of more cells than that, or with a
    quoted cell that is never closed. Shorter rows are left as they are.
    """
    encoding, text = _decoded(content)
    records = records_of(text.removeprefix("\ufeff"), sep)
    head = next(records, None)
    if head is None:
        raise ValueError("no header")
    names = column_names(head, sep)
    rows = [cells(r, sep) for r in records]
    if any(len(r) > len(names) for r in rows):
        raise ValueError("a row has more cells than the header")
    return encoding, names, rows


def admit_files(spark: SparkSession, path: str, max_mb: int = V.MAX_FILE_MB) -> DataFrame:
    """``(path, length, rows, reason)`` for every file below ``path``, files of no bytes among them.

    Ending and size are checked from the listing, so bytes are read only for the
    files that pass both; these are parsed as `parse_table` says, one file at a time.
    Workbooks are not readable here and say so.
    """
    files, parsed = list_files(spark, path), _parsed(max_mb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for content in batch.column("content"):
                try:
                    counts.append(len(parse_table(content.as_py())[2]))
                except ValueError:
                    counts.append(None)
            columns = [batch.column("path"), batch.column("length"), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "length", "rows"])

    opened = _in_fewer_tasks(files.where(parsed)).mapInArrow(run, "path string, length long, rows int")
    closed = _listed(files).where(~parsed | (F.col("length") == 0))
    judged = opened.unionByName(closed, allowMissingColumns=True)
    readable = F.col("rows").isNotNull()
    return judged.select(
        "path", "length", "rows",
        admission_reason(F.col("path"), F.col("length"), readable, F.col("rows"), max_mb).alias("reason"),
    )


def read_admitted_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, max_mb: int = V.MAX_FILE_MB
) -> DataFrame:
    """``(path, encoding, row_no, ...)``: the rows of all CSV files that are admitted, each in its own encoding.

    Cells are matched to the columns of ``schema`` by the names in the file's header,
    whatever their order; a column that the file lacks is NULL. Files that cannot be
    read have no rows here, `admit_files` says why. Files are spread over the cluster;
    the size rule bounds what one task holds.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = fields.names
    names = [f"c{i}" for i in range(len(wanted))]
    files, parsed = list_files(spark, path), _parsed(max_mb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    encoding, header, rows = parse_table(content.as_py())
                except ValueError:
                    continue
                at = [header.index(c) if c in header else len(header) for c in wanted]
                for first in range(0, len(rows), 4096):
                    some = rows[first : first + 4096]
                    columns = [[r[i] if i < len(r) else None for r in some] for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file] * len(some), pa.string()), pa.array([encoding] * len(some), pa.string()),
                            pa.array(range(first, first + len(some)), pa.int32()),
                            *[pa.array(c, pa.string()) for c in columns],
                        ],
                        names=["path", "encoding", "row_no", *names],
                    )

    as_text = "path string, encoding string, row_no int, " + ", ".join(f"{n} string" for n in names)
    rows = _in_fewer_tasks(files.where(parsed).select("path", "content")).mapInArrow(run, as_text)
    columns = [typed(null_if_missing(F.col(n)), f.dataType).alias(f.name) for n, f in zip(names, fields, strict=True)]
    return rows.select("path", "encoding", "row_no", *columns)
