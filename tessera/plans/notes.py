"""Notes beside the tables: the figures they print against those of record, and texts without the names of persons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import notes as O
from ..sources.analogue import BEFORE, CUTOFF, Reports
from .register import plan


def _shares(r: Reports) -> DataFrame:
    """Of each administrator at the cutoff: its share of the market and that of its largest vehicle in it, in per cent; and the share a month before."""
    j = r.sane.where(F.col("dt").isin(F.lit(BEFORE).cast("date"), F.lit(CUTOFF).cast("date"))).join(r.registry.select("cnpj", "admin"), "cnpj")

    def at(month: str):
        return F.when(F.col("dt") == F.lit(month).cast("date"), F.col("pl"))

    g = j.groupBy("admin").agg(F.sum(at(CUTOFF)).alias("now"), F.max(at(CUTOFF)).alias("top"), F.sum(at(BEFORE)).alias("was"))
    whole = g.agg(F.sum("now").alias("all_now"), F.sum("was").alias("all_was"))
    return g.crossJoin(F.broadcast(whole)).select("admin", (100 * F.col("now") / F.col("all_now")).alias("share"), (100 * F.col("top") / F.col("now")).alias("largest"), (100 * F.col("was") / F.col("all_was")).alias("old_share"))


def _notes(r: Reports) -> DataFrame:
    """A note of each administrator (some still print the share of the month before, some with a decimal comma), and the documents."""

    def printed(c: str, digits: int):
        return F.round(c, digits).cast(f"decimal(20,{digits})").cast("string")

    stale = F.length("admin") % 4 == 0
    share = F.when(stale, printed("old_share", 2)).otherwise(printed("share", 2))
    text = F.concat(F.col("admin"), F.lit(" holds "), share, F.lit("% of the market; its largest vehicle is "), printed("largest", 1), F.lit("% of that."))
    own = _shares(r).select(F.concat(F.lit("admin "), "admin").alias("note"), F.when(F.length("admin") % 3 == 0, F.translate(text, ".", ",")).otherwise(text).alias("text"))
    documents = r.table("documents").select(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("note"), "text")
    return own.unionByName(documents)


def _record(r: Reports) -> DataFrame:
    s = _shares(r)
    return s.select(F.concat(F.lit("share "), "admin").alias("name"), F.col("share").alias("value")).unionByName(s.select(F.concat(F.lit("largest "), "admin").alias("name"), F.col("largest").alias("value")))


_SHARES_SQL = f"""@ash AS (SELECT admin, 100*now/sum(now) OVER () AS share, 100*top/now AS largest, 100*was/sum(was) OVER () AS old_share FROM (SELECT admin, sum(pl) FILTER (dt='{CUTOFF}') AS now, max(pl) FILTER (dt='{CUTOFF}') AS top, sum(pl) FILTER (dt='{BEFORE}') AS was FROM sane JOIN registry USING (cnpj) GROUP BY 1)),
nt0 AS (SELECT admin, admin || ' holds ' || cast(cast(round(CASE WHEN length(admin)%4=0 THEN old_share ELSE share END,2) AS decimal(20,2)) AS varchar) || '% of the market; its largest vehicle is ' || cast(cast(round(largest,1) AS decimal(20,1)) AS varchar) || '% of that.' AS text FROM ash),
nt AS (SELECT 'admin ' || admin AS note, CASE WHEN length(admin)%3=0 THEN replace(text,'.',',') ELSE text END AS text FROM nt0 UNION ALL SELECT 'document ' || cast(doc_id AS varchar), text FROM documents),
fg0 AS (SELECT note, regexp_extract_all(text, '{O.PERCENT}') AS f FROM nt), fg AS (SELECT note, place-1 AS place, f[place] AS printed, cast(replace(rtrim(f[place],'%'),',','.') AS double) AS value, length(regexp_extract(f[place],'[.,]([0-9]+)',1)) AS decimals FROM (SELECT note, f, unnest(range(1,len(f)+1)) AS place FROM fg0)),
rec AS (SELECT 'share ' || admin AS name, share AS value FROM ash UNION ALL SELECT 'largest ' || admin, largest FROM ash)"""


@plan(_SHARES_SQL + " SELECT note, place, printed, name, CASE WHEN name IS NULL THEN 'ORPHAN' ELSE 'OK' END AS status FROM (SELECT note, place, printed, name, row_number() OVER (PARTITION BY note, place ORDER BY abs(fg.value-rec.value), name) AS k FROM fg LEFT JOIN rec ON abs(fg.value-rec.value)<=0.5*power(10,-decimals)*(1+1e-9)) WHERE k=1")
def note_figures(r: Reports) -> DataFrame:
    """Every percentage printed in a note or document, with the figure of record that it can be a rounding of, or none."""
    found = O.figures(_notes(r), "note", "text")
    return O.matched(found, _record(r)).select("note", "place", "printed", "name", "status")


@plan(_SHARES_SQL + ", sl AS (SELECT 'admin ' || admin AS note, 0 AS place, 'share ' || admin AS name, share AS value FROM ash UNION ALL SELECT 'admin ' || admin, 1, 'largest ' || admin, largest FROM ash) SELECT coalesce(sl.note, fg.note) AS note, coalesce(sl.place, fg.place) AS place, name, printed, CASE WHEN name IS NULL THEN 'EXTRA' WHEN fg.value IS NULL THEN 'MISSING' WHEN abs(fg.value-sl.value)<=0.5*power(10,-decimals)*(1+1e-9) THEN 'OK' ELSE 'FAIL' END AS status FROM sl FULL JOIN fg ON sl.note=fg.note AND sl.place=fg.place")
def note_slots(r: Reports) -> DataFrame:
    """The two figures that each administrator's note must print, recomputed; what no place asks for is extra."""
    s = _shares(r)
    note = F.concat(F.lit("admin "), "admin").alias("note")
    slots = s.select(note, F.lit(0).alias("place"), F.concat(F.lit("share "), "admin").alias("name"), F.col("share").alias("recorded"))
    slots = slots.unionByName(s.select(note, F.lit(1).alias("place"), F.concat(F.lit("largest "), "admin").alias("name"), F.col("largest").alias("recorded")))
    return O.expected(O.figures(_notes(r), "note", "text"), "note", slots).select("note", "place", "name", "printed", "status")


def _accounts(r: Reports) -> DataFrame:
    """Each document as the account of a proceeding: it names two customers, cites a process and goes on with its own text."""
    customers = r.table("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    n = customers.agg((F.max("c_custkey") + 1).alias("n"))
    d = r.table("documents").crossJoin(F.broadcast(n)).select("doc_id", "text", "source", "lang", ((F.col("doc_id") * 7) % F.col("n")).alias("k1"), ((F.col("doc_id") * 13 + 1) % F.col("n")).alias("k2"))
    one, two = (customers.select(F.col("c_custkey").alias(f"k{i}"), F.col("c_name").alias(f"name{i}"), F.col("c_mktsegment").alias(f"segment{i}")) for i in (1, 2))
    j = d.join(one, "k1").join(two, "k2")
    process = F.concat(F.lit("19957."), F.lpad((F.col("doc_id") % 89).cast("string"), 6, "0"), F.lit("/2001-0"), (F.col("doc_id") % 9 + 1).cast("string"))
    text = F.concat(F.lit("Process "), process, F.lit(": "), "name1", F.lit(" "), "segment1", F.lit(" and "), "name2", F.lit(", of "), "segment2", F.lit(". "), F.coalesce("text", F.lit("")), F.lit(" Signed: "), "name1", F.lit(";"), "name2", F.lit("."))
    return j.select("doc_id", "source", "lang", F.col("name1").alias("person"), text.alias("text"))


_ACCOUNTS_SQL = """WITH nn AS (SELECT max(c_custkey)+1 AS n FROM customer), acc AS (SELECT doc_id, source, lang, a.c_name AS person, 'Process 19957.' || lpad(cast(doc_id%89 AS varchar),6,'0') || '/2001-0' || cast(doc_id%9+1 AS varchar) || ': ' || a.c_name || ' ' || a.c_mktsegment || ' and ' || b.c_name || ', of ' || b.c_mktsegment || '. ' || coalesce(text,'') || ' Signed: ' || a.c_name || ';' || b.c_name || '.' AS text
FROM documents, nn JOIN customer a ON a.c_custkey=(doc_id*7)%n JOIN customer b ON b.c_custkey=(doc_id*13+1)%n)"""


@plan(_ACCOUNTS_SQL + """, pat AS (SELECT '\\b(?:' || string_agg(name, '|' ORDER BY length(name) DESC, name) || ')\\b' AS p FROM (SELECT c_name AS name FROM customer WHERE c_acctbal<0 UNION SELECT c_name || ' ' || c_mktsegment FROM customer WHERE c_acctbal<0))
SELECT doc_id, len(regexp_extract_all(text, p)) AS n_names, regexp_replace(text, p, '[person]', 'g') AS text FROM acc, pat""", base=False)
def person_suppression(r: Reports) -> DataFrame:
    """The accounts without the names of natural persons (here customers with a negative balance, by name or by name and segment)."""
    persons = r.table("customer").where("c_acctbal < 0")
    names = persons.select(F.col("c_name").alias("name")).union(persons.select(F.concat_ws(" ", "c_name", "c_mktsegment")))
    return O.suppressed(_accounts(r), "doc_id", "text", names).select("doc_id", "n_names", "text")


@plan(_ACCOUNTS_SQL + f" SELECT source, lang, count(DISTINCT person) AS n_persons, coalesce(string_agg(DISTINCT number, '; ' ORDER BY number),'') AS processes FROM (SELECT source, lang, person, unnest(CASE WHEN len(x)>0 THEN x ELSE [NULL] END) AS number FROM (SELECT *, regexp_extract_all(text, '{O.PROCESS}') AS x FROM acc)) GROUP BY 1,2", base=False)
def person_cases(r: Reports) -> DataFrame:
    """The accounts by case (source and language): how many persons, and the processes cited."""
    return O.cases(_accounts(r), ["source", "lang"], "person", "text")
