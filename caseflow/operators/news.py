"""Text search over a table of embedded articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.publish import public_reason
from caseflow.functions.vectors import cosine, embed_text, hashing_embedding
from caseflow.operators.reliability import latest_per_key, upsert

BACKEND = "hashing-ngram-local"


class BackendMismatch(RuntimeError):
    """Vectors of different embedders are never compared."""


def embed_articles(articles: DataFrame, ingested) -> DataFrame:
    text = F.concat_ws(" ", "title", "snippet")
    return articles.withColumns({"embedding": hashing_embedding(text), "embedding_backend": F.lit(BACKEND), "ingested_at": F.lit(ingested).cast("timestamp")})


def stored_backend(store: DataFrame) -> str | None:
    found = [r[0] for r in store.select("embedding_backend").distinct().limit(2).collect()]
    if len(found) > 1:
        raise BackendMismatch("the store holds vectors of several embedders")
    return found[0] if found else None


def top_similar(rows: DataFrame, query, k: int, vector: str = "embedding", tie: list | None = None) -> DataFrame:
    """The k most similar rows, exactly; rows without similarity last."""
    scored = rows.withColumn("similarity", cosine(F.col(vector), query))
    return scored.orderBy(F.desc_nulls_last("similarity"), *(tie or [])).limit(k)


def search(store: DataFrame, query: str, now, k: int = 5, max_age_days: int = 45) -> DataFrame:
    backend = stored_backend(store)
    if backend not in (None, BACKEND):
        raise BackendMismatch(f"the store's vectors are from {backend}")
    recent = store.where(F.col("published_at") >= F.lit(now) - F.expr(f"interval {max_age_days} days"))
    vector = F.array(*map(F.lit, embed_text(query)))
    found = top_similar(recent, vector, k, tie=[F.desc("published_at"), F.col("article_id")])
    return found.withColumn("similarity", F.round("similarity", 4))


def refreshed(old: DataFrame | None, new: DataFrame, ingested) -> DataFrame:
    """The store after an ingestion, latest of each article; where the old vectors are of another embedder, all are made anew."""
    rows = embed_articles(new, ingested)
    if old is None:
        return latest_per_key(rows, ["article_id"], "ingested_at")
    if stored_backend(old) not in (None, BACKEND):
        text = F.concat_ws(" ", "title", "snippet")
        old = old.withColumns({"embedding": hashing_embedding(text), "embedding_backend": F.lit(BACKEND)})
    return upsert(old.select(*rows.columns), rows, "article_id", "ingested_at")


def ingestion_summary(collected: int, stored: int, max_age_days: int, failed_feeds: list[str], failure: Exception | None = None) -> dict:
    """What an ingestion did; a failed write leaves the store as it was and is told without technical detail."""
    notice = public_reason(failure, "the store of news was not updated in this run; what it held before is used") if failure else None
    return {
        "janela_dias": max_age_days, "noticias_coletadas": collected, "noticias_gravadas": 0 if failure else stored, "feeds_com_falha": failed_feeds, "embedding_backend": BACKEND,
        "gravacao_degradada": notice, "status": "degraded" if failure or failed_feeds else "ok", "technical_detail": f"{type(failure).__name__}: {failure}" if failure else None,
    }


def store_stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("articles"), F.min("published_at").alias("oldest"), F.max("published_at").alias("newest"), F.max("ingested_at").alias("ingested"), F.min("embedding_backend").alias("backend"))


def search_envelope(found: DataFrame, query: str, max_age_days: int) -> dict:
    """The articles found, and the span of what was found."""
    rows = [r.asDict() for r in found.drop("embedding").collect()]  # k rows at most
    at = [r["published_at"] for r in rows if r["published_at"]]
    return {"query": query, "max_age_days": max_age_days, "resultados": rows, "mais_antiga": min(at, default=None), "mais_recente": max(at, default=None)}
