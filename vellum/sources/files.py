"""Readers of the file formats that the pipeline takes in."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY_AS_NULL = ""


def read_csv(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted fields over several lines and doubled quotes. Line breaks inside quotes become LF, invalid
    UTF-8 the replacement mark; an empty field is null. Without a schema every column is a string. Several paths must share
    a header."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").option("nullValue", EMPTY_AS_NULL)
    df = (r.schema(schema) if schema else r).csv(paths)
    return df.select(*[F.regexp_replace(f"`{c}`", "\r\n?", "\n").alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def read_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Term files: the consolidated one if it is there, else all of the single types, with the order of their rows."""
    try:
        df = read_csv(spark, f"{folder}/umls_terms.csv")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = read_csv(spark, f"{folder}/umls_T*.csv")
    return df.withColumn("seq", F.monotonically_increasing_id())


def read_piped(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A pipe-delimited table without header or quoting (RRF); fields beyond the names are dropped, missing ones null.
    Splittable, as the lines are read as text."""
    parts = F.split("value", r"\|", -1)
    return spark.read.text(path).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_zipped(spark: SparkSession, path: str, member: str, names: list[str], batch: int = 100_000) -> DataFrame:
    """The same from a member of a zip archive (the first whose name ends with `member`), streamed: the archive isn't
    splittable, so one task an archive reads it, in batches, never as a whole, from any store that Arrow can open. Bad UTF-8 is replaced."""
    schema = ", ".join(f"{n} string" for n in names)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for p in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if re.match("file:/[^/]", p) else p)
                with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    name = next((n for n in z.namelist() if n.endswith(member)), None)
                    if name is None:
                        raise FileNotFoundError(f"no {member} in {p}")
                    held: list[list[str | None]] = []
                    with z.open(name) as raw:
                        for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace"):
                            f = line.rstrip("\r\n").split("|")
                            held.append([f[i] if i < len(f) else None for i in range(len(names))])
                            if len(held) >= batch:
                                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held)))), arrow)
                                held = []
                    if held:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held)))), arrow)

    arrow = pa.schema([(n, pa.string()) for n in names])
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(rows, schema)


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(word, n) from a CSV with a word and a count; without the file an empty table: every word then counts as one."""
    schema = "word string, n bigint"
    try:
        return read_csv(spark, path, schema).filter("word is not null")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a model that sinks.write_model wrote."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def concepts_of_types(types: DataFrame, tuis: list[str]) -> DataFrame:
    """The distinct concepts of each type, from (CUI, TUI)."""
    return types.filter(F.col("TUI").isin(tuis)).select("CUI", "TUI").distinct()


def filtered_terms(concepts: DataFrame, types: DataFrame, tuis: list[str], vocabularies: str) -> DataFrame:
    """English terms that aren't suppressed, of vocabularies that match a pattern anywhere, joined with the types of their
    concepts: from concepts (CUI, LAT, SAB, TTY, STR, SUPPRESS) and types (CUI, TUI). One equi-join; filters reach the scans."""
    c = concepts.filter((F.col("LAT") == "ENG") & (F.col("SUPPRESS") == "N") & F.col("SAB").rlike(vocabularies))
    t = concepts_of_types(types, tuis)
    return c.join(t, "CUI").select(F.col("CUI").alias("cui"), F.col("TUI").alias("tui"), F.lower("STR").alias("term_norm"), F.col("STR").alias("term_pref"), F.col("SAB").alias("vocabulary"), F.col("TTY").alias("tty"))


def pasted(spark: SparkSession, text: str) -> DataFrame:
    """A pasted text as a table of one case, named by its hash."""
    return spark.createDataFrame([(text,)], "case_text string").select(F.concat(F.lit("pasted-"), F.substring(F.sha2("case_text", 256), 1, 16)).alias("case_id"), "case_text")
