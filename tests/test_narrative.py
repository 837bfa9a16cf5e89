"""What reports say, what may be published, budgets of tools, and the store of news."""

import datetime as dt
import json
import logging

import pytest
from pyspark.sql import functions as F

from caseflow.functions import publish as P
from caseflow.operators import guards as G
from caseflow.operators import news as N
from caseflow.plans import narrative as T
from caseflow.plans.catalog import TOOLS, Audit, planned, within_budget


def test_scrub_and_reasons():
    nested = {"quem": ["a@b.com", ("123.456.789-09", 7)], "x": {"My_Token": "t", "ok": "sem dados"}, "n": None}
    assert P.scrub(nested) == {"quem": ["[REDACTED]", ["[REDACTED]", 7]], "x": {"My_Token": "[REDACTED]", "ok": "sem dados"}, "n": None}
    assert P.public_reason(None, "falhou") == P.public_reason("erro 12", "falhou") == P.public_reason("Error code: 401 - {'a': 1} and more", "falhou") == "falhou"
    assert P.public_reason(ValueError("cannot open /var/lib/x/store.duckdb, PID 77, 3 tries"), "falhou") == "falhou (cannot open <omitido>, <omitido>, N tries)"
    long = P.public_reason("palavra " * 100, "falhou")
    assert long.endswith("palavra...)") and len(long) < 260
    assert P.public_reason("see https://a.b/c for details", "falhou") == "falhou (see http<omitido> for details)"  # an address goes as a path with a drive does


def test_log_lines():
    record = logging.makeLogRecord({"name": "x", "levelname": "INFO", "msg": "de %s", "args": ("a@b.com",), "senha_token": "s", "linhas": 3})
    token = P.run_id.set("r1")
    line = json.loads(P.JsonLines().format(record))
    P.run_id.reset(token)
    assert (line["message"], line["run_id"], line["senha_token"], line["linhas"], line["level"]) == ("de [REDACTED]", "r1", "[REDACTED]", 3, "INFO") and "msg" not in line
    assert "run_id" not in json.loads(P.JsonLines().format(record))
    assert P.cost(2, 1_000_000, 500_000, 0.4, 1.6)["custo_estimado_usd"] == 1.2


def metric(value, n=None, d=None, used=None, **components):
    return {"value": value, "numerator": n, "denominator": d, "records_used": used, "components": components, "unavailable_reason": None if value is not None else "no base", "period": {"inicio": "a", "fim": "b"}}


@pytest.mark.parametrize(("growth", "start"), [(8.0, "Casos estaveis"), (8.01, "Casos avancam 8,01%"), (-8.0, "Casos estaveis"), (-9.5, "Casos recuam 9,50%"), (None, "Sem base")])
def test_headline(growth, start):
    text = T.headline({"case_growth_rate": metric(growth), "mortality_rate": metric(5.0)}, "alerta")
    assert text.startswith(start) and text.endswith("letalidade de 5,00% entre casos encerrados; nivel ALERTA.")
    assert T.headline({}) == "Sem base para medir a variacao de casos; letalidade nao calculavel."


def test_points_scales_and_comparisons():
    known = {k: metric(1.0, 1, 2, 10) for k in T.POINTS} | {"incidence_rate": metric(3.0)}
    told = T.points(known, [{"title": "x" * 200}, {"title": "y"}])
    assert [k for k, _ in told] == ["DADO"] * 5 + ["CONTEXTO"] and T.points({"mortality_rate": metric(None)}) == []
    shares = T.bar_shares({"a": metric(1.0, -50, 100, 10), "b": metric(1.0, 25, None, 0), "c": metric(None)})
    assert shares == {"a": {"numerator": 100.0, "denominator": 100.0, "records_used": 100.0}, "b": {"numerator": 50.0, "records_used": 0.0}, "c": {}}
    assert [T.trend(*x) for x in ((0.0, True), (1.0, True), (1.0, False), (-1.0, True))] == [("→", "neutral"), ("▲", "bad"), ("▲", "good"), ("▼", "good")]
    change = {"execucao_anterior": "r", "variacao": {"case_growth_rate": {"variacao": -1.5}}}
    growth = metric(10.0, 1, 2, atual=110, anterior=100)
    assert T.comparison("case_growth_rate", growth, change) == "▼ 1,50 p.p. desde a execucao anterior"
    assert T.comparison("case_growth_rate", growth, {"variacao": {}}) == "▲ 110 vs 100 casos na janela anterior"
    assert T.comparison("seasonal_excess", metric(5.0, atual=1200, mediana=1000.5)) == "1.200 casos vs mediana de 1.000,50"
    assert T.comparison("mortality_rate", metric(5.0, 1, 20)) == "1 em 20" and T.comparison("x", metric(None)) == "a a b"


@pytest.mark.parametrize(("excess", "said"), [(19.99, "como se espera"), (20.0, "fora do padrao"), (-20.0, "fora do padrao"), (0, "na mediana")])
def test_paragraphs(excess, said):
    text = dict(T.paragraphs({"case_growth_rate": metric(None), "seasonal_excess": metric(excess), "mortality_rate": metric(2.0, 1, 50)}))
    assert text["Panorama"][0] == "case_growth_rate: sem valor (no base)." and said in text["Panorama"][1]
    assert text["Severidade"] == ["Letalidade: 2,00% (1 de 50)."] and text["Vacinacao declarada"] == []


def test_quality_section():
    load = {"rows_read": 2000, "rows_kept": 2000, "rows_dropped": 0, "rows_adjusted": 3, "identical_rows": 1, "observed": {"b": 0, "a": 20}, "flags": {"flag_x": 0}}
    text = T.quality_section(load, {"UTI": 10, "EVOLUCAO": 0, "OUTRA": 4})
    assert "| a | 20 | 1,00 |" in text and "| b |" not in text and "| flag_x | 0 | 0,00 |" in text and "| UTI | 10 |" in text and "EVOLUCAO" not in text and "OUTRA" not in text
    assert "n/d" in T.quality_section(load | {"rows_kept": 0})


def test_plans_budgets_and_steps():
    names = list(TOOLS)[:3]
    assert planned(names[:2], [names[1], names[2], "unknown"]) == names
    calls = within_budget([("unknown", {}), *((n, {}) for n in names)], 2)
    assert [x[2] for x in calls] == [False, True, True, False] and within_budget([], 2) == []
    audit = Audit()
    with audit.step("plan", quem="a@b.com") as told:
        told["summary"] = "3 tools"
    with audit.step("news") as told:
        told["degraded"] = True
    with pytest.raises(ValueError, match="bad"), audit.step("x"):
        raise ValueError("bad a@b.com")
    assert [(e["node"], e["status"]) for e in audit.events] == [("plan", "ok"), ("news", "degraded"), ("x", "error")]
    assert "a@b.com" not in str(audit.events) and audit.summary()["by_status"] == {"ok": 1, "degraded": 1, "error": 1}


def test_requests_with_filters(spark):
    ok = G.validated_request(spark, "evolução de casos", " sp ", 5)
    assert ok["verdict"] == "accepted" and ok["filters"] == {"uf": "SP", "classification": 5}
    assert G.validated_request(spark, "evolução de casos", "XX")["verdict"] == G.validated_request(spark, "casos", None, 6)["verdict"] == "invalid_filter"
    assert G.validated_request(spark, "drop table x", "XX")["verdict"] == "prompt_injection" and G.validated_request(spark, None, "XX")["verdict"] == "empty_request"


def test_store_is_made_anew_for_another_embedder(spark):
    day = dt.datetime(2026, 8, 20)
    items = lambda *rows: spark.createDataFrame(list(rows), "article_id string, title string, snippet string, url string, published_at timestamp")
    store = N.refreshed(None, items(("1", "Gripe", "", "u1", day), ("2", "Covid", "", "u2", day)), day)
    other = store.withColumns({"embedding_backend": F.lit("other"), "embedding": F.array(F.lit(1.0))})
    got = {r["article_id"]: r for r in N.refreshed(other, items(("2", "Vacina", "", "u3", day)), day + dt.timedelta(days=1)).collect()}
    assert sorted(got) == ["1", "2"] and got["2"]["title"] == "Vacina" and all(len(r["embedding"]) == 512 and r["embedding_backend"] == N.BACKEND for r in got.values())
    done = N.ingestion_summary(3, 3, 45, [])
    assert (done["status"], done["noticias_gravadas"], done["gravacao_degradada"]) == ("ok", 3, None)
    bad = N.ingestion_summary(3, 3, 45, ["f"], OSError("lock on /data/x/store.parquet held"))
    assert bad["status"] == "degraded" and bad["noticias_gravadas"] == 0 and "/data" not in bad["gravacao_degradada"] and "/data" in bad["technical_detail"]
