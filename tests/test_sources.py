"""Reading and writing: feeds, references, history, audit, manifests."""

import json

import pytest
from pyspark.sql import functions as F

from caseflow.schema import AUDIT, BED_TYPES, UF_CODES
from caseflow.sources import readers as R
from caseflow.sources import sinks as K


def test_feed(spark, tmp_path):
    path = tmp_path / "f.xml"
    path.write_text(
        '<rss><channel><item><title>Gripe avança</title><link>https://news.google.com/x?url=https://who.int/a</link><pubDate>Tue, 18 Aug 2026 10:00:00 GMT</pubDate><description>&lt;b&gt;Casos&lt;/b&gt;  sobem</description><source url="https://www.who.int">WHO</source></item>'
        "<item><title>Outra</title><link>https://a.b/c</link><pubDate>x</pubDate><description>d</description></item></channel></rss>",
        encoding="utf-8",
    )
    got = {r["title"]: r for r in R.read_feed(spark, str(path)).collect()}
    assert got["Gripe avança"]["publisher_url"] == "https://www.who.int" and got["Gripe avança"]["snippet"] == "Casos sobem" and got["Gripe avança"]["published_at"].isoformat() == "2026-08-18T10:00:00"
    assert got["Outra"]["published_at"] is None and len(got["Outra"]["article_id"]) == 16


def test_population_of_the_service(spark):
    payload = json.dumps([{"resultados": [{"series": [{"localidade": {"id": "35"}, "serie": {"2025": "46000000", "2024": "..."}}, {"localidade": {"id": "99"}, "serie": {"2025": "1"}}]}]}])
    assert [tuple(r) for r in R.population_from_api(spark, payload, {"35": "SP"}).collect()] == [("SP", 2025, 46000000)]


def test_resources(spark):
    pages = spark.createDataFrame([('<a href="/x/INFLUD25-01-01.csv">a</a> <a href="/x/INFLUD25-09-01.csv">',), ("INFLUD24.csv none.csv",), (None,)], "html string")
    assert sorted(map(tuple, R.discover_resources(pages).select("year", "name").collect())) == [(2024, "INFLUD24.csv"), (2025, "INFLUD25-09-01.csv")]


def test_beds_and_doses(spark, tmp_path):
    cells = {c: "0" for pair in BED_TYPES.values() for c in pair}
    raw = [{"COMP": "202601", "UF": '"sp"'} | cells | {"UTI_ADULTO_EXIST": "10", "UTI_ADULTO_SUS": "4.0"}, {"COMP": "202613", "UF": "SP"} | cells | {"UTI_ADULTO_EXIST": "9"}, {"COMP": "202601", "UF": "SP"} | cells | {"UTI_ADULTO_EXIST": "5"}]
    beds = R.aggregate_beds(spark.createDataFrame(raw), "u", "2026-01-01").collect()
    assert [(r["uf"], r["competencia"], r["tipo_leito"], r["leitos_existentes"], r["leitos_sus"]) for r in beds] == [("SP", "2026-01", "UTI_ADULTO", 15, 4)]
    for i, day in enumerate(("2026-01-05", "2026-02-05", "2025-02-05")):
        (tmp_path / f"{i}.csv").write_text(f"sg_uf_paciente;ds_nome;dt_vacina;st_documento\nSP;gripe;{day};final\n")
    target = spark.createDataFrame([("SP", "influenza", 100)], "uf string, campanha string, populacao_alvo bigint")
    got = R.build_vaccination(spark, [str(tmp_path / f"{i}.csv") for i in range(3)], 2026, target, True).collect()
    assert [(r["uf"], r["campanha"], r["doses_aplicadas"], r["populacao_alvo"], r["periodo_completo"]) for r in got] == [("SP", "influenza", 2, 100, True)]


def test_references_and_their_rules(spark, tmp_path):
    assert R.read_population(spark, "/nonexistent").count() == R.read_capacity(spark, "/nonexistent").count() == R.read_vaccination(spark, "/nonexistent").count() == 0
    path = str(tmp_path / "p.csv")
    df = spark.createDataFrame([(u, 2025, 10) for u in UF_CODES], "uf string, ano int, populacao bigint")
    K.write_reference(df, path, ["uf", "ano"], {"fonte": "x"})
    assert R.read_population(spark, path).count() == len(UF_CODES)
    origin = R.read_provenance(str(tmp_path / "p.provenance.json"))
    assert origin["fonte"] == "x" and origin["rows"] == len(UF_CODES) and len(origin["sha256"]) == 64 and R.read_provenance("/nonexistent") == {}
    K.write_reference(df.where("uf != 'SP'"), path, ["uf"], {})
    with pytest.raises(R.ReferenceError):
        R.read_population(spark, path)


def test_manifest(tmp_path):
    manifest, file = str(tmp_path / "m.json"), tmp_path / "INFLUD25-x.csv"
    file.write_bytes(b"abc")
    assert R.source_update(manifest) == {"disponivel": False, "obtido_em": None, "anos": []}
    entry = R.register_local_file(manifest, str(file))
    assert entry["year"] == 2025 and entry["size_bytes"] == 3 and entry["sha256"].startswith("ba7816bf")
    told = R.source_update(manifest)
    assert told["disponivel"] and told["anos"] == ["2025"] and told["obtido_em"] == entry["downloaded_at"]
    with pytest.raises(ValueError, match="no year"):
        R.register_local_file(manifest, str(tmp_path / "x.csv"))


def test_history_audit_and_views(spark, tmp_path):
    path = str(tmp_path / "h.jsonl")
    K.append_json(path, {"run_id": "r1", "indicadores": {"a": 1.5}, "uf": None})
    with open(path, "a", encoding="utf-8") as f:
        f.write("{broken\n")
    K.append_json(path, {"run_id": "r2", "uf": "SP"})
    assert sorted(r["run_id"] for r in R.read_history(spark, path).collect()) == ["r1", "r2"]
    log = str(tmp_path / "a.jsonl")
    for run, seq in (("b", 2), ("a", 1), ("b", 1)):
        K.append_json(log, {"run_id": run, "seq": seq, "tool": "t", "duration_ms": 1.0})
    events = R.read_audit(spark, log)
    assert [(r["run_id"], r["seq"]) for r in events.collect()] == [("a", 1), ("b", 1), ("b", 2)]
    out = str(tmp_path / "audit")
    K.replace_run(events, out)
    K.replace_run(events.where("run_id = 'b' and seq = 1"), out)
    assert sorted((r["run_id"], r["seq"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1)]
    assert K.register_views({"v_one": spark.range(3), "v_two": spark.range(0)}) == {"v_one": 3, "v_two": 0} and spark.table("v_one").count() == 3
    assert set(events.columns) == {c.split()[0] for c in AUDIT.split(", ")}


def test_tables_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, at int, v string")
    K.upsert_table(spark, path, rows(("a", 1, "x"), ("b", 1, "y")), "k", "at")
    K.upsert_table(spark, path, rows(("a", 2, "z"), ("b", 0, "old")), "k", "at")
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "at", "v").collect())) == [("a", 2, "z"), ("b", 1, "y")]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("t")] == ["t"]
    assert spark.read.parquet(path).where(F.col("k") == "c").count() == 0
