"""Figures in notes, names in texts, court documents of any shape, claims and compiled tables, on rows small enough to work out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import notes as O
from tessera.operators import tables as A
from tessera.sources import court as C


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_figures_in_texts(spark):
    df = spark.createDataFrame([(1, "of 12,5% and 3% not 4 but 0.25%"), (2, None), (3, ""), (4, "%5 % 7.%")], "k int, t string")
    assert rows(O.figures(df, "k", "t")) == [(1, 0, "12,5%", 12.5, 1), (1, 1, "3%", 3.0, 0), (1, 2, "0.25%", 0.25, 2)]


def test_figures_meet_values_that_round_to_them(spark):
    rng = random.Random(1)
    record = [(f"v{i:03}", rng.uniform(0, 30)) for i in range(200)] + [("nul", None), ("b", 7.25), ("a", 7.35), ("neg", -3.0)]
    texts = [(i, f"{rng.uniform(0, 40):.{rng.randint(0, 3)}f}%") for i in range(300)] + [(900, "7.3%"), (901, "7.3%"), (902, "99999.5%")]
    found = O.figures(spark.createDataFrame(texts, "k int, t string"), "k", "t")
    got = {r.k: (r.status, r.name) for r in O.matched(found, spark.createDataFrame(record, "name string, value double")).collect()}
    for k, t in texts:
        number = float(t.rstrip("%"))
        width = 0.5 * 10.0 ** -len(t.rstrip("%").partition(".")[2]) * (1 + 1e-9)
        near = sorted((abs(number - v), n) for n, v in record if v is not None and abs(number - v) <= width)
        assert got[k] == (("OK", near[0][1]) if near else ("ORPHAN", None)), (k, t)
    assert {s for s, _ in got.values()} == {"OK", "ORPHAN"}


def test_figures_at_their_places(spark):
    notes = spark.createDataFrame([("n", "10,1% then 20.0% and 5%"), ("m", "no figure")], "note string, text string")
    slots = spark.createDataFrame([("n", 0, "a", 10.14), ("n", 1, "b", 21.0), ("m", 0, "c", 1.0)], "note string, place int, name string, recorded double")
    got = {(r.note, r.place): r.status for r in O.expected(O.figures(notes, "note", "text"), "note", slots).collect()}
    assert got == {("n", 0): "OK", ("n", 1): "FAIL", ("n", 2): "EXTRA", ("m", 0): "MISSING"}


@pytest.mark.parametrize("small", [True, False])
def test_names_are_taken_out(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(O, "few", lambda df, rows=0: df)
    rng = random.Random(2)
    names = ["Ana", "Ana Bo", "Ana Bo Cé", "Bo", "d'Or", "Élan 7", " lead", "", "É"]
    words = ["Ana", "Bo", "Cé", "d'Or", "Élan", "7", "x", "lead", "Anab", "É"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) + rng.choice(["", ".", " "]) for _ in range(120)]
    texts += [None, "", "Ana", "Ana  Bo", "AnaBo", "xAna", "Ana-Bo", "(Ana Bo)", "ana", "Ana " * 4000]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts)], "id int, __x string, text string")
    table = spark.createDataFrame([(n,) for n in [*names, "Ana", None]], "name string")
    got = {r.id: (r.text, r.n_names) for r in O.suppressed(df, "id", "text", table, "<P>").collect()}
    known = sorted((n for n in names if n and n[0] != " "), key=len, reverse=True)
    pattern = re.compile(r"(?<![\w#])(?:" + "|".join(map(re.escape, known)) + r")(?![\w#])")
    for i, t in enumerate(texts):
        assert got[i] == ((None, 0) if t is None else pattern.subn("<P>", t)), t
    nobody = O.suppressed(df, "id", "text", table.limit(0), "<P>")
    assert {(r.id, r.text, r.n_names) for r in nobody.collect()} == {(i, t, 0) for i, t in enumerate(texts)}


def test_persons_by_case(spark):
    people = spark.createDataFrame([("A", None, "p", "see 12345.678901/2001-02"), ("A", None, "q", "12345.678901/2001-02, 12345.678901/2000-01"), ("A", None, "p", None), ("B", 1, None, "none")], "kind string, day int, who string, text string")
    assert rows(O.cases(people, ["kind", "day"], "who", "text")) == [("A", None, 2, "12345.678901/2000-01; 12345.678901/2001-02"), ("B", 1, 0, "")]


def test_court_documents_of_any_shape(spark):
    moves = '{"nome":"a","dataHora":"2024-01"}', '{"nome":"b","dataHora":"2024-03"}', '{"nome":"c"}'
    texts = [
        f'{{"id":"1","numeroProcesso":"11","movimentos":[{",".join(moves)}],"orgaoJulgador":{{"nome":"V","codigoMunicipioIBGE":35}},"classe":{{"codigo":129,"nome":"RJ"}},"dataAjuizamento":"20240131120000","assuntos":[{{"nome":"x"}},{{"nome":null}},{{"nome":"y"}}]}}',
        f'{{"id":"2","movimentos":[[{moves[1]}],[[{moves[0]}],7,null,"s",{moves[2]}]],"orgaoJulgador":[{{"nome":"U"}},{{"nome":"V"}}],"classe":[[{{"codigo":"108"}}]]}}',
        f'{{"id":"3","movimentos":{moves[0]},"orgaoJulgador":[],"dataAjuizamento":"bad","assuntos":"text"}}',
        '{"id":"4","movimentos":null}', "no json", None, "[1]",
        '{"id":"5","movimentos":[{"nome":"first","dataHora":"2024-03"},{"nome":"last","dataHora":"2024-03"}]}',
    ]
    got = C.processes(spark.createDataFrame([(t,) for t in texts], "json string")).collect()
    one, two, three, four, *rest, tie = got
    assert (one.numero_processo, one.classe_codigo, one.classe_nome, str(one.data_ajuizamento), one.orgao_julgador, one.municipio_ibge, one.assuntos) == ("11", 129, "RJ", "2024-01-31 12:00:00", "V", 35, "y; x")
    assert [(r.n_movimentos, r.ultimo_movimento, r.data_ultimo_movimento) for r in (one, two, three, four)] == [(3, "b", "2024-03"), (3, "b", "2024-03"), (1, "a", "2024-01"), (0, None, None)]
    assert (two.orgao_julgador, two.classe_codigo, three.orgao_julgador, three.data_ajuizamento, three.assuntos) == ("V", 108, None, None, "")
    assert all(r.id is None and r.n_movimentos == 0 and r.tem_partes is False for r in rest) and len(rest) == 3
    assert tie.ultimo_movimento == "last"


def test_documents_as_first_seen(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4), ("b", 3)], "id string, at int")
    assert rows(C.first_seen(df, "id", [F.col("at")])) == [("a", 1), ("b", 3), (None, 4)]


def test_roles(spark):
    said = {"Devedor que CEDEU": "FIDC com exposição a cedente em RJ + FIDC com exposição a sacado em RJ", "recompra; coobrigado": "empresa com coobrigação", "credor habilitado": "FIDC credor", "": C.UNLISTED, None: C.UNLISTED}
    df = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r.t: r.x for r in df.select("t", C.role(F.col("t"), F.lit(False)).alias("x")).collect()} == said
    assert df.where("t IS NULL").select(C.role(F.col("t"), F.lit(True))).first()[0] == C.LISTED


def test_claims(spark):
    claims = [A.Claim(k, "s", "un", "p", "c", None if k == "text" else k) for k in ("same", "near", "far", "lost", "zero", "text")]
    published = spark.createDataFrame([("same", 5.0), ("near", 100.0), ("far", 100.0), ("lost", 1.0), ("zero", 0.0)], "key string, value double")
    again = spark.createDataFrame([("same", 5.0), ("near", 100.4), ("far", 101.0), ("zero", 0.0)], "key string, again double")
    found = A.book(spark, claims, published, again)
    assert {r.claim: r.status for r in found.collect()} == {"same": "OK", "near": "OK", "far": "DIVERGES", "lost": "MISSING", "zero": "OK", "text": "CURATED"}
    with pytest.raises(ValueError, match="far, lost"):
        A.check_book(found)
    A.check_book(found.where("claim <> 'far' AND claim <> 'lost'"))


def test_compiled_tables_carry_units(spark):
    df = spark.createDataFrame([(7.0, "b", 2.0), (123.0, "a", 3.0), (5.0, "c", 1.0)], "cnpj double, name string, pl double")
    top = A.compiled(df, {"cnpj": "id", "none": "un", "pl": "brl"}, [F.desc("pl")], 2)
    assert [tuple(r) for r in top.collect()] == [("00000000000123", 3.0), ("00000000000007", 2.0)]
    assert A.units(top.where("pl > 2").select("pl", "cnpj", (F.col("pl") * 2).alias("twice")).limit(1)) == {"pl": "brl", "cnpj": "id", "twice": "auto"}
    assert rows(A.described(spark, {"t": top})) == [("t", 0, "cnpj", "id"), ("t", 1, "pl", "brl")]
