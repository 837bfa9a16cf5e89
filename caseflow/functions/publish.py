"""What may leave the system: nested values without personal data, reasons without technical detail, lines of a log."""

from __future__ import annotations

import datetime
import json
import logging
import re
from contextvars import ContextVar

from caseflow.functions.text import MASK, PII, SECRETS, SENSITIVE_KEYS


def as_python(java: str) -> re.Pattern:
    """A pattern of the text checks for single texts; ``U`` asks for Unicode classes, which are the default here."""
    mark = re.match(r"\(\?([imsU]+)\)", java)
    letters = mark[1] if mark else ""
    flags = sum({"i": re.I, "m": re.M, "s": re.S}[x] for x in letters if x != "U")
    return re.compile(java[len(mark[0]) if mark else 0 :], flags if "U" in letters else flags | re.A)


PERSONAL = [as_python(p) for p in (*PII.values(), *SECRETS)]


def scrub(value):
    """A nested value with personal data and secrets masked at any depth, whole where a key names a secret."""
    match value:
        case str():
            for p in PERSONAL:
                value = p.sub(MASK, value)
            return value
        case dict():
            return {k: MASK if any(x in str(k).lower() for x in SENSITIVE_KEYS) else scrub(v) for k, v in value.items()}
        case list() | tuple():
            return [scrub(v) for v in value]
    return value


# What is technical in a message, in the order in which it is replaced, and by what.
TECHNICAL = (
    (r'(?m)Traceback \(most recent call last\):|\s*File "[^"]+", line \d+.*', " "),
    (r"""[A-Za-z]:[\\/][^\s"',;)]+|(?<![\w:/])/(?:[\w.\-+]+/)+[\w.\-+]*""", "<omitido>"),
    (r"\b[\w.-]+\.(?:duckdb|parquet|jsonl|json|csv|wal|db|sqlite|log|py)\b", "o acervo local"),
    (r"(?i)\b(?:PID|processo|process|port|porta)\s*[:=]?\s*\d+", "<omitido>"),
    (r"\d[\d.,:]*", "N"),
    (r"\s+", " "),
)
LEAST_REASON, MOST_REASON = 12, 240


def public_reason(detail, fallback: str) -> str:
    """A failure as a sentence for readers: no paths, processes, numbers or dumps; the fallback alone where nothing is left."""
    told = str(detail or "")
    for pattern, instead in TECHNICAL:
        told = re.sub(pattern, instead, told)
    told = told.strip(" \t\n\r.;,")
    if len(told) < LEAST_REASON or {"{", "}"} & set(told):
        return fallback
    short = told if len(told) <= MOST_REASON else told[:MOST_REASON].rpartition(" ")[0] + "..."
    return f"{fallback} ({short})"


#: The run whose steps are being logged.
run_id: ContextVar[str | None] = ContextVar("run_id", default=None)
OWN_FIELDS = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    """A record as one line of JSON, scrubbed, with the run and whatever else it was given."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"timestamp": datetime.datetime.fromtimestamp(record.created, datetime.UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line |= {"run_id": run_id.get()} if run_id.get() else {}
        line |= {k: v for k, v in vars(record).items() if k not in OWN_FIELDS and k[0] != "_"}
        line |= {"error": self.formatException(record.exc_info)} if record.exc_info else {}
        return json.dumps(scrub(line), ensure_ascii=False, default=str)


def cost(calls: int, tokens_in: int, tokens_out: int, price_in: float, price_out: float) -> dict:
    """What a number of tokens costs at prices for a million; an estimate, no invoice."""
    return {"chamadas": calls, "tokens_entrada": tokens_in, "tokens_saida": tokens_out, "tokens_total": tokens_in + tokens_out, "custo_estimado_usd": round((tokens_in * price_in + tokens_out * price_out) / 1e6, 6)}
