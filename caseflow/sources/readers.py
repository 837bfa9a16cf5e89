"""Reading case files, extracts and references, each with its schema and its checks."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.codes import campaign, tolerant_bool, tolerant_int
from caseflow.functions.dates import competence, rfc822, strip
from caseflow.functions.text import article_id, canonical_url, on_topic, publisher_url, snippet, trusted
from caseflow.schema import ALLOWED_COLUMNS, BED_TYPES, CAMPAIGNS, CAPACITY, HISTORY, POPULATION, UF_CODES, VACCINATION, check_columns, require_columns


class ReferenceError(ValueError):
    """A reference table that breaks its rules."""


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if the whole file decodes as such, else ISO-8859-1 (a cut-off character at the end included).

    Lines are read as ISO-8859-1, which maps bytes to characters one to one, and checked as UTF-8 where they
    lie, so a file of any size is checked by many tasks.
    """
    lines = spark.read.option("encoding", "ISO-8859-1").csv(path, schema="line string", sep="\x01", quote="", escape="")
    bad = lines.where(F.col("line").isNotNull() & ~F.expr("is_valid_utf8(cast(encode(line, 'ISO-8859-1') as string))")).limit(1).count()
    return "ISO-8859-1" if bad else "UTF-8"


def csv_columns(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> list[str]:
    """The header alone."""
    return spark.read.options(sep=sep, header=True, encoding=encoding).csv(path).columns


def read_text_csv(spark: SparkSession, path: str | list[str], sep: str = ";", encoding: str = "UTF-8", **options) -> DataFrame:
    """All columns as text; an empty cell, quoted or not, is null."""
    first = path if isinstance(path, str) else path[0]
    columns = csv_columns(spark, first, sep, encoding)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(sep=sep, header=True, encoding=encoding, **options).csv(path)


def read_cases(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Allowed columns of a yearly case file; the scan reads no others."""
    raw = read_text_csv(spark, path, ";", encoding or detect_encoding(spark, path))
    return raw.select(*[c for c in raw.columns if c in ALLOWED_COLUMNS])


def year_of(name: str) -> int | None:
    """The year in a file name such as ``INFLUD25-...``."""
    found = re.search(r"(?i)INFLUD(\d{2})", os.path.basename(name))
    return 2000 + int(found[1]) if found else None


def read_processed(spark: SparkSession, path: str, view: str = "srag_cases") -> DataFrame:
    """The processed layer as a view; refused if a denied column is there or a needed one is not."""
    df = spark.read.parquet(path)
    check_columns(df.columns)
    require_columns(df.columns, ("DT_SIN_PRI", "DT_DIGITA", "flag_data_invalida", "SG_UF_NOT"))
    df.createOrReplaceTempView(view)
    return df


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def checked(df: DataFrame, rules: dict[str, str], unique: list[str] | None = None) -> DataFrame:
    """Raises with the first broken rule: predicates that every row must meet, and a unique key."""
    sums = [F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(f"r{i}") for i, p in enumerate(rules.values())]
    row = df.agg(F.count("*").alias("n"), *sums).first()
    for i, name in enumerate(rules):
        if row[f"r{i}"]:
            raise ReferenceError(f"{row[f'r{i}']} rows break the rule: {name}")
    if unique and df.groupBy(*unique).count().where("count > 1").limit(1).count():
        raise ReferenceError(f"rows repeat the key {', '.join(unique)}")
    return df


STATES = ", ".join(f"'{u}'" for u in UF_CODES)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """An empty table where there is no file, so that indicators can say what is missing."""
    if not exists(spark, path):
        return empty(spark, POPULATION)
    df = spark.read.schema(POPULATION).options(header=True, comment="#").csv(path)
    checked(df, {"known state": f"uf in ({STATES})", "positive population": "populacao > 0"}, ["uf", "ano"])
    if df.groupBy("ano").agg(F.count_distinct("uf").alias("n")).where(F.col("n") != len(UF_CODES)).limit(1).count():
        raise ReferenceError("a year does not have all states")
    return df


def read_vaccination(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return empty(spark, VACCINATION)
    raw = read_text_csv(spark, path, ",", comment="#")
    require_columns(raw.columns, ("uf", "ano", "campanha", "doses_aplicadas", "populacao_alvo", "fonte", "url"))
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in ("data_extracao", "periodo_completo") if c not in raw.columns})
    df = raw.select(
        F.upper("uf").alias("uf"), F.col("ano").try_cast("int").alias("ano"), F.lower("campanha").alias("campanha"), F.col("doses_aplicadas").try_cast("double").cast("bigint").alias("doses_aplicadas"),
        F.col("populacao_alvo").try_cast("double").cast("bigint").alias("populacao_alvo"), "fonte", "url", "data_extracao", tolerant_bool(F.col("periodo_completo")).alias("periodo_completo"),
    )
    names = ", ".join(f"'{c}'" for c in CAMPAIGNS)
    return checked(
        df,
        {"known state": f"uf in ({STATES})", "a year": "ano is not null", "known campaign": f"campanha in ({names})", "doses from 0 on": "doses_aplicadas >= 0", "no target or one above 0": "populacao_alvo is null or populacao_alvo > 0"},
        ["uf", "ano", "campanha"],
    )


def read_capacity(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return empty(spark, CAPACITY)
    df = spark.read.schema(CAPACITY).options(header=True, comment="#").csv(path)
    types = ", ".join(f"'{t}'" for t in BED_TYPES)
    rules = {
        "known state": f"uf in ({STATES})",
        "a month": "competencia rlike '^[0-9]{4}-(0[1-9]|1[0-2])$'",
        "known type": f"tipo_leito in ({types})",
        "beds from 0 on": "leitos_existentes >= 0 and leitos_sus >= 0",
        "public beds among all": "leitos_sus <= leitos_existentes",
    }
    return checked(df, rules, ["uf", "competencia", "tipo_leito"])


def read_target_population(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("uf string, campanha string, populacao_alvo bigint").options(header=True, comment="#").csv(path).where("populacao_alvo is not null")


def aggregate_beds(raw: DataFrame, url: str, extracted: str) -> DataFrame:
    """An extract with a pair of columns per bed type, as rows of state, month and type."""
    require_columns(raw.columns, ("COMP", "UF", *(c for pair in BED_TYPES.values() for c in pair)))
    parts = ", ".join(f"'{t}', `{a}`, `{b}`" for t, (a, b) in BED_TYPES.items())
    long = raw.selectExpr("COMP", "UF", f"stack({len(BED_TYPES)}, {parts}) as (tipo_leito, e, s)")
    long = long.select(competence(F.col("COMP")).alias("competencia"), F.upper(strip(F.regexp_replace("UF", '"', ""))).alias("uf"), "tipo_leito", tolerant_int(F.col("e")).alias("e"), tolerant_int(F.col("s")).alias("s"))
    good = long.where(F.col("competencia").isNotNull() & F.col("uf").isin(*UF_CODES) & ((F.col("e") != 0) | (F.col("s") != 0)))
    out = good.groupBy("uf", "competencia", "tipo_leito").agg(F.sum("e").alias("leitos_existentes"), F.sum("s").alias("leitos_sus"))
    return out.select("uf", "competencia", "tipo_leito", "leitos_existentes", "leitos_sus", F.lit("CNES").alias("fonte"), F.lit(url).alias("url"), F.lit(extracted).alias("data_extracao"))


def dose_reason(year: int | None = None):
    """Why a dose is left out, first reason first; null for one that counts."""
    final = F.lower(strip(F.coalesce("st_documento", F.lit("")))) == "final"
    uf = F.upper(strip(F.coalesce("sg_uf_paciente", F.lit(""))))
    reason = F.when(~final, F.lit("documento_nao_final")).when(campaign(F.col("ds_nome")).isNull(), F.lit("fora_do_escopo")).when(~uf.isin(*UF_CODES), F.lit("uf_invalida"))
    return reason if year is None else reason.when(F.coalesce(F.substring("dt_vacina", 1, 4), F.lit("")) != str(year), F.lit("outro_ano"))


def aggregate_doses(raw: DataFrame, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Doses by state and campaign, and rows left out by reason."""
    require_columns(raw.columns, ("sg_uf_paciente", "ds_nome", "dt_vacina", "st_documento"))
    marked = raw.select(F.upper(strip(F.col("sg_uf_paciente"))).alias("uf"), campaign(F.col("ds_nome")).alias("campanha"), dose_reason(year).alias("motivo"))
    doses = marked.where("motivo is null").groupBy("uf", "campanha").agg(F.count("*").alias("doses_aplicadas"))
    return doses, marked.groupBy(F.coalesce("motivo", F.lit("contadas")).alias("motivo")).agg(F.count("*").alias("linhas"))


def build_vaccination(spark: SparkSession, extracts: list[str], year: int, target: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """The vaccination reference from several monthly extracts (Windows-1252 read as ISO-8859-1)."""
    doses, _ = aggregate_doses(read_text_csv(spark, extracts, ";", "ISO-8859-1"), year)
    target = target if target is not None else spark.createDataFrame([], "uf string, campanha string, populacao_alvo bigint")
    return doses.join(target, ["uf", "campanha"], "left").select(
        "uf", F.lit(year).alias("ano"), "campanha", "doses_aplicadas", "populacao_alvo", F.lit("SI-PNI").alias("fonte"), F.lit("").alias("url"), F.lit(None).cast("string").alias("data_extracao"), F.lit(complete).alias("periodo_completo")
    )


def population_from_api(spark: SparkSession, payload: str, codes: dict[str, str]) -> DataFrame:
    """Rows of state, year and residents from the nested answer of the statistics service."""
    schema = "array<struct<resultados:array<struct<series:array<struct<localidade:struct<id:string>,serie:map<string,string>>>>>>>"
    found = spark.createDataFrame([(payload,)], "p string").select(F.explode(F.from_json("p", schema)).alias("v")).select(F.explode("v.resultados").alias("r")).select(F.explode("r.series").alias("s"))
    rows = found.select(F.col("s.localidade.id").alias("id"), F.explode("s.serie").alias("ano", "populacao"))
    names = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return rows.select(names[F.col("id")].alias("uf"), F.col("ano").cast("int").alias("ano"), F.col("populacao").try_cast("bigint").alias("populacao")).where("uf is not null and populacao is not null")


def discover_resources(pages: DataFrame, html: str = "html") -> DataFrame:
    """Yearly files linked from pages: the greatest name of each year."""
    links = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"(?i)([^\"'/\s]*INFLUD\d{2}[^\"'/\s]*\.csv)"), F.lit(1))).alias("name"))
    return links.withColumn("year", F.regexp_extract("name", r"(?i)INFLUD(\d{2})", 1).cast("int") + 2000).groupBy("year").agg(F.max("name").alias("name"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of saved feeds, with the publisher's address, the id and a plain snippet."""
    schema = "title string, link string, pubDate string, description string, source struct<_VALUE:string,_url:string>"
    items = spark.read.format("xml").schema(schema).options(rowTag="item").load(path)
    url = publisher_url(F.col("source._url"), F.col("link"))
    return items.select(
        "title", F.col("source._VALUE").alias("source"), rfc822(F.col("pubDate")).alias("published_at"), F.col("link").alias("url"), url.alias("publisher_url"),
        article_id(F.col("title"), F.col("link")).alias("article_id"), snippet(F.col("description")).alias("snippet"), canonical_url(F.col("link")).alias("canonical_url"),
    )


def collect_articles(items: DataFrame, now, max_age_days: int = 45, trusted_only: bool = True, order: str = "published_at") -> DataFrame:
    """Recent articles on the topic, one per id, latest first."""
    rows = items.where(on_topic(F.col("title")) & (F.col("published_at") >= F.lit(now) - F.expr(f"interval {max_age_days} days")))
    rows = rows.where(trusted(F.col("publisher_url"))) if trusted_only else rows
    one = rows.groupBy("article_id").agg(F.min_by(F.struct(*rows.columns), F.struct(order, "url")).alias("r")).select("r.*")
    return one.orderBy(F.desc("published_at"), "article_id")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Runs of former reports; lines that can't be read are skipped."""
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path).where("run_id is not null")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    from caseflow.schema import AUDIT

    return spark.read.schema(AUDIT).json(path).orderBy("run_id", "seq")


def read_provenance(path: str) -> dict:
    """What is known of a reference's origin; empty if nothing is."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def source_update(manifest: str) -> dict:
    """When the raw files were obtained, by the manifest of ingestion."""
    entries = read_provenance(manifest)
    entries = list(entries.values()) if isinstance(entries, dict) else entries
    at = [e["downloaded_at"] for e in entries if isinstance(e, dict) and e.get("downloaded_at")]
    return {"disponivel": bool(at), "obtido_em": max(at, default=None), "anos": sorted(str(e.get("year")) for e in entries if isinstance(e, dict))}


def register_local_file(manifest: str, path: str, year: int | None = None) -> dict:
    """Adds a local file to the manifest with its size and SHA-256."""
    import datetime
    import hashlib

    year = year or year_of(path)
    if year is None:
        raise ValueError(f"no year in the name of {path}")
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    entries = read_provenance(manifest)
    entries[str(year)] = {
        "year": year, "filename": os.path.basename(path), "path": path, "url": None, "origin": "local", "size_bytes": os.path.getsize(path), "sha256": digest.hexdigest(),
        "downloaded_at": datetime.datetime.now(datetime.UTC).isoformat(),
    }
    part = f"{manifest}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(entries, f, indent=1)
    os.replace(part, manifest)
    return entries[str(year)]
