"""Court documents whose fields change shape: an object, a list of objects, or lists in lists, from one document to the next.

The text is parsed to VARIANT, which holds any shape; fields are opened by what they are in each document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lists in lists are opened to this depth.
DEPTH = 6


def objects(field: Column, depth: int = DEPTH) -> Column:
    """All objects in a VARIANT that is an object, a list, or lists in lists to ``depth``; anything else in it is left out. They come from the
    last to the first, so that the first of them is the latest entered."""
    items = F.array(field)
    for _ in range(depth):
        # what is no list stays as it is
        items = F.flatten(F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))))
    return F.reverse(F.filter(items, lambda x: x.isNotNull() & F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))))


def _text(x: Column, path: str) -> Column:
    return F.try_variant_get(x, path, "string")


def processes(documents: DataFrame, column: str = "json") -> DataFrame:
    """One row for each document of JSON text, with its process's number, class, body, subjects and movements; the last movement is that with the
    greatest time, of equal ones the first of ``objects``. Text that is no JSON gives a row of nulls, ``n_movimentos`` 0. Parties are never
    in the source, and the marker says so."""
    d = documents.select(F.try_parse_json(column).alias("d"))

    def field(name: str) -> Column:
        return F.try_variant_get("d", f"$.{name}", "variant")

    opened = d.select("d", *[objects(field(n)).alias(n) for n in ("movimentos", "orgaoJulgador", "classe", "assuntos")])
    moves = F.transform("movimentos", lambda m: F.struct(_text(m, "$.nome").alias("nome"), _text(m, "$.dataHora").alias("at")))

    def later(best: Column, m: Column) -> Column:
        return F.when(best["seen"] & (F.coalesce(best["at"], F.lit("")) >= F.coalesce(m["at"], F.lit(""))), best).otherwise(F.struct(F.lit(True).alias("seen"), m["nome"].alias("nome"), m["at"].alias("at")))

    none = F.struct(F.lit(False).alias("seen"), F.lit(None).cast("string").alias("nome"), F.lit(None).cast("string").alias("at"))
    last = F.aggregate(moves, none, later)
    subjects = F.filter(F.transform("assuntos", lambda a: _text(a, "$.nome")), lambda n: n.isNotNull() & (n != ""))

    def first(c: str) -> Column:
        return F.try_element_at(c, F.lit(1))

    return opened.select(
        _text(F.col("d"), "$.id").alias("id"), _text(F.col("d"), "$.tribunal").alias("tribunal"), _text(F.col("d"), "$.grau").alias("grau"), _text(F.col("d"), "$.numeroProcesso").alias("numero_processo"),
        F.try_variant_get(first("classe"), "$.codigo", "long").alias("classe_codigo"), _text(first("classe"), "$.nome").alias("classe_nome"), F.try_to_timestamp(_text(F.col("d"), "$.dataAjuizamento"), F.lit("yyyyMMddHHmmss")).alias("data_ajuizamento"),
        _text(first("orgaoJulgador"), "$.nome").alias("orgao_julgador"), F.try_variant_get(first("orgaoJulgador"), "$.codigoMunicipioIBGE", "long").alias("municipio_ibge"),
        F.array_join(subjects, "; ").alias("assuntos"), F.coalesce(F.size("movimentos"), F.lit(0)).alias("n_movimentos"), last["nome"].alias("ultimo_movimento"), last["at"].alias("data_ultimo_movimento"), F.lit(False).alias("tem_partes"),
    )


def first_seen(documents: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first document of each key in ``order`` (total), as overlapping queries give a process several times; null keys are one key."""
    return documents.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


@dataclass(frozen=True)
class Rule:
    words: tuple[str, ...]
    role: str


# fixed values: the roles that a text's words give, and what is said without any
ROLES = (
    Rule(("cedente", "originador", "cedeu", "cessão", "cessao"), "FIDC com exposição a cedente em RJ"),
    Rule(("sacado", "devedor"), "FIDC com exposição a sacado em RJ"),
    Rule(("coobrig", "recompra"), "empresa com coobrigação"),
    Rule(("credor", "habilit"), "FIDC credor"),
)
LISTED, UNLISTED = "FIDC com exposição a cedente em RJ", "relação apenas hipotética"


def role(text: Column, listed: Column, rules: tuple[Rule, ...] = ROLES) -> Column:
    """The roles whose words a text has, in the order of the rules, each once, joined by " + "; roles do not exclude each other. A text
    with none is told by whether the company is ``listed``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for r in rules:
        any_ = F.lit(False)
        for w in r.words:
            any_ = any_ | F.contains(low, F.lit(w))
        found.append(F.when(any_, F.lit(r.role)))
    roles = F.array_distinct(F.array_compact(F.array(*found)))
    return F.when(F.size(roles) > 0, F.array_join(roles, " + ")).otherwise(F.when(listed, LISTED).otherwise(UNLISTED))
