"""Checks of requests and outputs, over tables of texts and for single texts with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.codes import ratio
from caseflow.functions.text import ATTRIBUTION, CAUSAL, NUMBER, PERCENT, PRESCRIPTIVE, any_of, benign, close, find_pii, injection_findings, parse_number, request_verdict, risk_of, sentences
from caseflow.operators.filters import AnalyticFilters, InvalidFilterError


def judge_requests(texts: DataFrame, text: str = "text") -> DataFrame:
    """``findings`` (patterns run once a text), the ``risk`` that follows from them, and the ``verdict``."""
    c = F.col(text)
    found = texts.withColumn("findings", injection_findings(F.coalesce(c, F.lit(""))))
    judged = found.withColumn("risk", risk_of(F.col("findings")))
    return judged.withColumn("verdict", request_verdict(c, F.col("risk"))).select(*texts.columns, "verdict", "risk", "findings")


def validated_request(spark, text: str | None, uf: str | None = None, classification: int | None = None) -> dict:
    """One request and its filters: refused for its text first, then for a filter outside its domain."""
    row = judge_requests(spark.createDataFrame([(text,)], "text string")).first()
    out = {"verdict": row["verdict"], "risk": row["risk"], "findings": row["findings"], "filters": None, "detail": None}
    if out["verdict"] == "accepted":
        try:
            out["filters"] = AnalyticFilters(uf, classification).to_dict()
        except InvalidFilterError as e:
            out |= {"verdict": "invalid_filter", "detail": str(e)}
    return out


def cited_numbers(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, raw, number, is_percent`` of every number in a text."""
    spot = F.regexp_extract_all(text, F.lit(rf"(?:{NUMBER})(?:\s*(?:%|(?i:por\s+cento|pontos?\s+percentuais?|p\.p\.)))?"), F.lit(0))
    found = texts.select(key, F.explode(spot).alias("spot"))
    raw = F.regexp_extract("spot", NUMBER, 0)
    rest = F.substring(F.col("spot"), F.length(raw) + 1, F.length("spot"))
    return found.select(key, raw.alias("raw"), parse_number(raw).alias("number"), rest.rlike(f"(?i){PERCENT}").alias("is_percent")).where("number is not null")


def evidence_variants(evidence: DataFrame, value: str = "value") -> DataFrame:
    """Ways in which a value may be written: 0 to 3 decimals, with and without sign."""
    v = F.col(value).cast("double")
    kinds = F.array_distinct(F.array(*(F.bround(x, d) for d in range(4) for x in (v, F.abs(v)))))
    return evidence.where(v.isNotNull()).select(F.explode(kinds).alias("value")).distinct()


def unsupported_numbers(cited: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """Cited numbers that no evidence supports.

    A number needs evidence unless it is a small whole number or a year and no per cent.  Numbers
    and evidence meet on whole parts (and their neighbours) or, from 1,000 on, on a logarithmic
    grid with cells of a thousandth, so no number is compared with all evidence.  Each distinct number
    is looked up once, however often it is cited.
    """
    cell = lambda c: F.floor(F.log(F.greatest(F.abs(c), F.lit(1.0))) / 0.001)
    cited = cited.where(F.col("is_percent") | ~benign(F.col("number")))
    places = lambda c, span: F.concat(F.transform(F.array(*map(F.lit, span)), lambda k: F.concat(F.lit("w"), (F.floor(c) + k).cast("string"))), F.transform(F.array(*map(F.lit, span)), lambda k: F.concat(F.when(c < 0, F.lit("n")).otherwise(F.lit("p")), (cell(c) + k).cast("string"))))
    left = cited.select("number").distinct().withColumn("place", F.explode(F.array_distinct(places(F.col("number"), (-2, -1, 0, 1, 2)))))
    right = variants.withColumn("place", F.explode(places(F.col("value"), (0,))))
    good = left.join(right, "place").where(close(F.col("number"), F.col("value"))).select("number").distinct()
    return cited.join(good, "number", "left_anti").select(key, "raw", "number", "is_percent")


def causal_without_source(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sentences that claim a cause while neither they nor the one before name a source."""
    s = sentences(F.col(text))
    pairs = F.arrays_zip(s.alias("sentence"), F.concat(F.array(F.lit(None).cast("string")), s).alias("before"))  # each beside the one before it
    rows = texts.select(key, F.posexplode(pairs).alias("pos", "pair")).select(key, "pos", "pair.sentence", "pair.before").where("sentence is not null")
    return rows.where(any_of(F.col("sentence"), CAUSAL) & ~any_of(F.concat_ws(" ", "before", "sentence"), ATTRIBUTION)).select(key, "pos", "sentence")


def error_rates(judged: DataFrame, expected: str, got: str, by: list[str] | None = None) -> DataFrame:
    """Of judged examples whose right answer is known: how many should be and were refused, and the shares wrongly refused and wrongly let pass."""
    should, did = F.coalesce(F.col(expected), F.lit(False)), F.coalesce(F.col(got), F.lit(False))
    counts = judged.groupBy(*(by or [])).agg(
        F.count("*").alias("exemplos"), F.count_if(should).alias("a_recusar"), F.count_if(did).alias("recusados"), F.count_if(~should & did).alias("falsos_positivos"), F.count_if(should & ~did).alias("falsos_negativos")
    )
    return counts.withColumns({"taxa_falsos_positivos": ratio(F.col("falsos_positivos"), F.col("exemplos") - F.col("a_recusar")), "taxa_falsos_negativos": ratio(F.col("falsos_negativos"), F.col("a_recusar"))})


def judge_outputs(texts: DataFrame, evidence: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, policies``: what a text must not be published for, sorted; empty if nothing."""
    base = texts.select(key, text)
    own = base.select(key, F.when(F.size(find_pii(F.col(text))) > 0, F.lit("sensitive_data")).alias("a"), F.when(any_of(F.col(text), PRESCRIPTIVE), F.lit("medical_advice")).alias("b"))
    own = own.select(key, F.explode(F.array_compact(F.array("a", "b"))).alias("policy"))
    numbers = unsupported_numbers(cited_numbers(base, key, text), evidence_variants(evidence), key).select(key, F.lit("evidence_binding").alias("policy"))
    causes = causal_without_source(base, key, text).select(key, F.lit("evidence_binding").alias("policy"))
    found = own.unionByName(numbers).unionByName(causes).groupBy(key).agg(F.array_sort(F.collect_set("policy")).alias("policies"))
    return base.select(key).join(found, key, "left").select(key, F.coalesce("policies", F.array().cast("array<string>")).alias("policies"))


def numbers_in(payload, origin: str = "") -> list[tuple[str, float]]:
    """Numbers of a nested result with where they stand; truth values and texts are none."""
    if isinstance(payload, dict):
        return [x for k, v in payload.items() for x in numbers_in(v, f"{origin}.{k}" if origin else str(k))]
    if isinstance(payload, (list, tuple)):
        return [x for v in payload for x in numbers_in(v, origin)]
    if isinstance(payload, (int, float)) and not isinstance(payload, bool):
        return [(origin, float(payload))]
    return []
