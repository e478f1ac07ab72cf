"""Court documents made of the event stream, in every shape that the source sends, and the role of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import court as C
from ..sources.analogue import Reports
from .register import plan

#: What the registry says of a company, by kind of event.
_NATURE = {"click": "Cedente e também devedor da carteira", "view": "credor habilitado", "purchase": "Recompra pelo originador", "error": "", "scroll": "sacado"}


def _documents(r: Reports) -> DataFrame:
    """A document for each event, once or (every fifth) twice, with the later one changed: two movements, a body and two subjects, as objects,
    lists, or lists in lists."""
    e = r.table("events").withColumn("k", F.get_json_object("props", "$.k"))
    one = F.concat(F.lit('{"nome":"'), "event_type", F.lit('","dataHora":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"}'))
    two = F.concat(F.lit('{"nome":"K'), "k", F.lit('","dataHora":"2024-01-'), F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0"), F.lit('T12:00:00"}'))
    body = F.concat(F.lit('{"nome":"Vara '), (F.col("user_id") % 7).cast("string"), F.lit('","codigoMunicipioIBGE":'), "k", F.lit("}"))
    subjects = F.concat(F.lit('[{"nome":"'), "event_type", F.lit('"},{"nome":null},{"nome":"k'), "k", F.lit('"}]'))
    shape = F.col("event_id") % 4
    moves = F.when(shape == 0, F.concat(F.lit("["), one, F.lit(","), two, F.lit("]"))).when(shape == 1, F.concat(F.lit("[["), one, F.lit("],[["), two, F.lit("]]]"))).when(shape == 2, one).otherwise(F.lit("null"))
    seat = F.when(shape == 0, body).when(shape == 1, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.concat(F.lit('[[{"nome":"old"},'), body, F.lit("]]")))
    text = F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('","numeroProcesso":"'), F.lpad("event_id", 20, "0"), F.lit('","classe":{"codigo":129,"nome":"RJ"},"dataAjuizamento":"'), F.date_format("ts", "yyyyMMddHHmmss"), F.lit('","orgaoJulgador":'), seat, F.lit(',"assuntos":'), subjects, F.lit(',"movimentos":'), moves, F.lit("}"))
    base = e.select("event_id", F.lit(1).alias("query"), text.alias("json"))
    again = base.where("event_id % 5 = 0").select("event_id", F.lit(2).alias("query"), F.replace("json", F.lit('"codigo":129'), F.lit('"codigo":108')).alias("json"))
    return base.unionByName(again)


@plan("""WITH e AS (SELECT *, json_extract_string(props,'$.k') AS k, event_id%4 AS shape, strftime(ts,'%Y-%m-%dT%H:%M:%S') AS t1, '2024-01-' || lpad(cast(event_id%28+1 AS varchar),2,'0') || 'T12:00:00' AS t2 FROM events)
SELECT lpad(cast(event_id AS varchar),20,'0') AS numero_processo, CAST(129 AS BIGINT) AS classe_codigo, date_trunc('second', ts) AS data_ajuizamento, 'Vara ' || cast(user_id%7 AS varchar) AS orgao_julgador, cast(k AS bigint) AS municipio_ibge, 'k' || k || '; ' || event_type AS assuntos,
CASE WHEN shape<2 THEN 2 WHEN shape=2 THEN 1 ELSE 0 END AS n_movimentos, CASE WHEN shape<2 THEN CASE WHEN t2>=t1 THEN 'K' || k ELSE event_type END WHEN shape=2 THEN event_type END AS ultimo_movimento, CASE WHEN shape<2 THEN greatest(t1,t2) WHEN shape=2 THEN t1 END AS data_ultimo_movimento FROM e""", base=False)
def court_documents(r: Reports) -> DataFrame:
    """Each process as first seen, whatever shape its fields have."""
    seen = C.first_seen(_documents(r), "event_id", [F.col("query")])
    p = C.processes(seen)
    return p.select("numero_processo", "classe_codigo", F.col("data_ajuizamento").cast("timestamp_ntz").alias("data_ajuizamento"), "orgao_julgador", "municipio_ibge", "assuntos", "n_movimentos", "ultimo_movimento", "data_ultimo_movimento")


_NATURE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NATURE.items()) + " END"
_ROLE_SQL = ", ".join("CASE WHEN " + " OR ".join(f"contains(n,'{w}')" for w in r.words) + f" THEN '{r.role}' END" for r in C.ROLES)


@plan(f"WITH e AS (SELECT event_type, user_id%2=0 AS listed, lower(coalesce({_NATURE_SQL},'')) AS n FROM events), x AS (SELECT event_type, listed, array_to_string(list_filter([{_ROLE_SQL}], lambda v: v IS NOT NULL),' + ') AS roles FROM e) SELECT event_type, listed, CASE WHEN roles<>'' THEN roles WHEN listed THEN '{C.LISTED}' ELSE '{C.UNLISTED}' END AS papel, count(*) AS n FROM x GROUP BY 1,2,3", base=False)
def court_roles(r: Reports) -> DataFrame:
    """The role of a company in a proceeding, by what is said of it."""
    nature = F.create_map(*[F.lit(x) for kv in _NATURE.items() for x in kv])
    e = r.table("events").select("event_type", (F.col("user_id") % 2 == 0).alias("listed"), nature[F.col("event_type")].alias("nature"))
    return e.select("event_type", "listed", C.role(F.col("nature"), F.col("listed")).alias("papel")).groupBy("event_type", "listed", "papel").agg(F.count("*").alias("n"))
