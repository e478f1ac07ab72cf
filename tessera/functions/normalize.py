"""Column functions that clean identifiers, numbers and names. Absent stays NULL everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with accents and their plain forms (fixed values).
ACCENTED, PLAIN = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "AAAAAEEEEIIIIOOOOOUUUUCN"


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def number(c: Column) -> Column:
    """Text to double; what is no number becomes NULL, never an error or zero."""
    return c.try_cast("double")


def ratio(n: Column, d: Column) -> Column:
    """n / d where d is positive, else NULL."""
    return F.when(d > 0, n / d)


def document_id(c: Column) -> Column:
    """Company (14 digits) or person (11 digits) number, left zeros restored; shorter ones are dropped."""
    d = digits_only(c)
    n = F.length(d)
    return F.when(n >= 12, F.lpad(d, 14, "0")).when(n >= 11, F.lpad(d, 11, "0"))


def strict_sum(*parts: Column) -> Column:
    """NULL if any part is."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def lenient_sum(*parts: Column) -> Column:
    """NULL parts count as zero."""
    return strict_sum(*[F.coalesce(p, F.lit(0.0)) for p in parts])


def tranche(name: Column) -> Column:
    """Tranche of a series by its name; the order of the tests matters."""
    plain = F.translate(F.upper(name), ACCENTED, PLAIN)
    return (
        F.when(name.isNull(), "nao_informado")
        .when(plain.contains("MEZANINO"), "mezanino")
        .when(plain.contains("SUBORDINADA"), "subordinada")
        .when(plain.contains("SENIOR"), "senior")
        .when(plain.contains("UNICA"), "classe_unica")
        .otherwise("outra")
    )


def legacy_keys(df: DataFrame) -> DataFrame:
    """Both layout generations under one set of key names."""
    if "CNPJ_FUNDO" in df.columns:
        df = df.withColumnRenamed("CNPJ_FUNDO", "CNPJ_FUNDO_CLASSE")
    if "TP_FUNDO_CLASSE" not in df.columns:
        df = df.withColumn("TP_FUNDO_CLASSE", F.lit("Fundo"))
    return df.withColumn("CNPJ", digits_only(F.col("CNPJ_FUNDO_CLASSE")))


def numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as doubles; those that are missing as NULL."""
    return df.withColumns({c: number(F.col(c)) if c in df.columns else F.lit(None).cast("double") for c in names})
