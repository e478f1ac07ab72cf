"""Raw-file sources on files written by the tests."""

import hashlib
import zipfile

from tessera.sources import files as S


def test_layouts_are_united_by_name(spark, tmp_path):
    (tmp_path / "inf_mensal_fidc_tab_IV_202401.csv").write_bytes("CNPJ_FUNDO;DENOM_SOCIAL;VL\n1;JO\"SÉ;10\n".encode("latin1"))
    (tmp_path / "inf_mensal_fidc_tab_IV_202501.csv").write_bytes("TP_FUNDO_CLASSE;CNPJ_FUNDO_CLASSE;VL\nClasse;2;\n".encode("latin1"))
    (tmp_path / "inf_mensal_fidc_tab_I_202501.csv").write_text("A;B\n1;2\n")
    got = S.read_layouts(spark, str(tmp_path), "IV")
    rows = {r.period: r for r in got.collect()}
    assert set(rows) == {"202401", "202501"}
    assert rows["202401"].DENOM_SOCIAL == 'JO"SÉ' and rows["202401"].VL == "10" and rows["202401"].TP_FUNDO_CLASSE is None
    assert rows["202501"].CNPJ_FUNDO is None and rows["202501"].VL is None and rows["202501"].TP_FUNDO_CLASSE == "Classe"
    assert S.read_layouts(spark, str(tmp_path), "XX").columns == ["file", "period"]
    assert {r.file.split("/")[-1]: r["columns"] for r in S.headers(spark, str(tmp_path)).collect()}["inf_mensal_fidc_tab_I_202501.csv"] == ["A", "B"]


def test_archives_and_manifest(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.csv", "1;2")
        z.writestr("two.csv", "")
    got = {r.member: bytes(r.content) for r in S.archive_members(spark, str(tmp_path)).collect()}
    assert got == {"x/one.csv": b"1;2", "two.csv": b""}
    row = S.manifest(spark, str(tmp_path)).first()
    content = (tmp_path / "a.zip").read_bytes()
    assert row[:] == ("a.zip", len(content), hashlib.sha256(content).hexdigest())


def test_field_descriptions(spark):
    one = "-----\nCampo: A\n-----\n   Descrição : first  \n   Domínio: n\nCampo: B\n Domínio: n\nCampo: C\n Descrição: third\n Descrição: more\n"
    df = spark.createDataFrame([("meta_tab_I.txt", one), ("meta_tab_X_2.txt", "Campo: A\nDescrição: later\nCampo: D\nDescrição:\n"), ("other.txt", one)], "name string, text string")
    assert sorted(map(tuple, S.field_descriptions(df).collect())) == [("A", "I", "first"), ("C", "I", "third"), ("D", "X_2", "")]


def test_processes(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"tribunal":"T","grau":"G1","numeroProcesso":"1","classe":{"codigo":129,"nome":"RJ"},"dataAjuizamento":"20240131120000","orgaoJulgador":{"nome":"V"},"assuntos":[{"nome":"a"},{"nome":null},{"nome":"b"}],"movimentos":[{"nome":"x","dataHora":"2024-02"},{"nome":"y","dataHora":"2024-03"}]},{"tribunal":"T","numeroProcesso":"2","dataAjuizamento":"bad"}]')
    one, two = S.processes(spark.read.option("multiLine", True).json(str(tmp_path))).orderBy("numero_processo").collect()
    assert (one.assuntos, one.n_movimentos, one.ultimo_movimento, one.data_ultimo_movimento, one.tem_partes) == ("a; b", 2, "y", "2024-03", False)
    assert two.data_ajuizamento is None and two.n_movimentos == 0 and two.ultimo_movimento is None and two.assuntos == ""


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "a int, b string")
    S.write_parquet(df, str(tmp_path / "p"))
    S.write_csv(df, str(tmp_path / "c"), small=True)
    S.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect())) == [(1, None), (2, "é")]
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    assert {r.value for r in spark.read.text(str(tmp_path / "j")).collect()} == {'{"a":1,"b":null}', '{"a":2,"b":"é"}'}
    assert [r[1:] for r in S.catalogue(spark, {"t": df}).collect()] == [(0, "a", "int"), (1, "b", "string")]
