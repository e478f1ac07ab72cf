"""Raw report files: archives, CSV files of several layouts, field descriptions, process documents, manifest; sinks.

Files are listed and read by Spark, so any store it reads will do. Rows keep the name of their file, which is
what "last" means for keep-last.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Format of the published files (fixed values).
SEPARATOR, ENCODING = ";", "ISO-8859-1"


def report_pattern(table: str) -> str:
    """Names of a report table's files; the group is the period."""
    return rf"inf_mensal_fidc_tab_{table}_(\d{{4,6}})\.csv$"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, columns): the first line of each file, cut at separators. Only the first block of a file is kept."""
    read = spark.read.schema("line string").option("sep", "\u0001").option("quote", "").option("encoding", ENCODING).csv(path)
    first = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "line").where("block = 0")
    return first.groupBy("file").agg(F.min_by("line", "at").alias("line")).select("file", F.transform(F.split("line", SEPARATOR), lambda c: F.trim(c)).alias("columns"))


def read_layouts(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """All CSV files under ``path`` (of one report table, if given) with text columns, whatever their layouts:
    a read for each distinct header, united by name, columns that a layout lacks NULL. Adds file and period.

    What the driver holds is the list of files, as for any read. No file gives no columns but file and period.
    """
    found = headers(spark, path).withColumn("name", F.element_at(F.split("file", "/"), -1))
    if table is not None:
        found = found.where(F.col("name").rlike(report_pattern(table)))
    layouts = found.groupBy("columns").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("files").collect()
    parts = []
    for layout in layouts:
        read = spark.read.schema(", ".join(f"`{c}` string" for c in layout["columns"])).options(sep=SEPARATOR, encoding=ENCODING, header=True, quote="", enforceSchema=True).csv(layout.files)
        name = F.col("_metadata.file_name")
        parts.append(read.select("*", name.alias("file"), F.regexp_extract(name, r"_(\d{4,6})\.csv$", 1).alias("period")))
    if not parts:
        return spark.createDataFrame([], "file string, period string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Rows (archive, member, content) of ZIP files, a task for each few archives; folders are left out."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            yield pd.DataFrame({"archive": [name], "member": [m.filename], "content": [z.read(m)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, member string, content binary")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, bytes, sha256) of source files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def field_descriptions(texts: DataFrame) -> DataFrame:
    """Rows (field, table, description) from rows (name, text) of description files ``..._tab_<table>.txt``:
    a line "Campo: x" names a field, the next line "Descrição: ..." before another field describes it. A field
    that several files describe keeps the first by name. A file is one row, so no order of lines is lost."""
    tagged = texts.withColumn("table", F.regexp_extract("name", r"tab_([A-Z_0-9]+)\.txt$", 1)).where("`table` <> ''")
    blocks = tagged.select("name", "table", F.posexplode(F.split("text", r"(?m)^Campo:\s*(?=\S)")).alias("at", "block")).where("at > 0")
    described = blocks.select("name", "table", "at", F.regexp_extract("block", r"^(\S+)", 1).alias("field"), F.trim(F.regexp_extract("block", r"(?m)^[ \t]*Descrição[ \t]*:[ \t]*([^\r\n]*)", 1)).alias("description"), F.col("block").rlike(r"(?m)^[ \t]*Descrição[ \t]*:").alias("has"))
    return described.where("has").groupBy("field").agg(F.min_by(F.struct("table", "description"), F.struct("name", "at")).alias("x")).select("field", "x.table", "x.description")


def processes(docs: DataFrame) -> DataFrame:
    """One row for each court process from documents with nested movements and subjects (arrays of structs);
    the last movement is that with the greatest time. Parties are never in the source, and the marker says so."""

    def or_empty(c: str) -> Column:
        return F.coalesce(F.col(c), F.array())

    return docs.select(
        F.col("tribunal"), F.col("grau"), F.col("numeroProcesso").alias("numero_processo"), F.col("classe.codigo").alias("classe_codigo"), F.col("classe.nome").alias("classe_nome"),
        F.try_to_timestamp("dataAjuizamento", F.lit("yyyyMMddHHmmss")).alias("data_ajuizamento"), F.col("orgaoJulgador.nome").alias("orgao_julgador"),
        F.array_join(F.filter(F.transform(or_empty("assuntos"), lambda a: a["nome"]), lambda n: n.isNotNull() & (n != "")), "; ").alias("assuntos"), F.size(or_empty("movimentos")).alias("n_movimentos"),
        F.try_element_at(F.array_sort(F.transform(or_empty("movimentos"), lambda m: F.struct(F.coalesce(m["dataHora"], F.lit("")).alias("at"), m["nome"].alias("nome")))), F.lit(-1))["nome"].alias("ultimo_movimento"),
        F.array_max(F.transform(or_empty("movimentos"), lambda m: m["dataHora"])).alias("data_ultimo_movimento"), F.lit(False).alias("tem_partes"),
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, small: bool = False) -> None:
    """CSV with header; ``small`` (an indicator's few rows) goes to one file."""
    (df.coalesce(1) if small else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One compact JSON object a line, NULL fields kept as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table, position, column, type) of the schemas; nothing is read."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "`table` string, position int, `column` string, type string")
