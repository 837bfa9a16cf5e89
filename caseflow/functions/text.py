"""Text checks as columns: personal data, instructions aimed at a model, links, numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.dates import strip
from caseflow.functions.vectors import fold

MASK = "[REDACTED]"
# Patterns of personal data and secrets, in the order in which they are masked.
PII = {
    "cpf": r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b",
    "cns": r"\b[1-9]\d{2}[ .]?\d{4}[ .]?\d{4}[ .]?\d{4}\b",
    "email": r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "telefone": r"(?<!\d)(?:\+55\s?)?\(?\d{2}\)?\s?9?\d{4}[-\s]?\d{4}(?!\d)",
    "cep": r"\b\d{5}-\d{3}\b",
    "data_nascimento": r"(?i)\bnascid[oa]\s+em\s+\d{2}/\d{2}/\d{4}\b",
}
SECRETS = (r"\bsk-[A-Za-z0-9_-]{12,}\b", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}\b")
SENSITIVE_KEYS = ("api_key", "apikey", "authorization", "password", "secret", "token")
# Patterns of instructions aimed at a model; those of the second group are of medium risk.
INJECTION_HIGH = {
    "override_de_instrucoes": r"(?iU)\b(ignore|ignora|ignorar|desconsidere|desconsiderar|esque[cç]a|esquecer|disregard|forget|override)\b[^.\n]{0,60}\b(instru\w+|regra\w*|diretriz\w*|orienta\w+|prompt|guardrail\w*|restri\w+|anterior\w*|acima|previous|system)\b",
    "novo_papel_ou_persona": r"(?iU)\b(voc[eê]\s+(agora\s+)?(e|é|sera|será)|aja\s+como|finja\s+que|pretend\s+to\s+be|you\s+are\s+now|act\s+as)\b[^.\n]{0,60}\b(assistente|agente|modelo|sistema|dan|desenvolvedor|admin\w*|sem\s+restri\w+|sem\s+filtro|modo\s+\w+)\b",
    "modo_privilegiado": r"(?iU)\b(developer\s+mode|modo\s+(desenvolvedor|debug|deus|livre|irrestrito)|jailbreak|do\s+anything\s+now|sudo|root\s+access)\b",
    "extracao_de_prompt": r"(?iU)\b(revele|revelar|mostre|mostrar|exiba|exibir|imprima|imprimir|repita|repetir|liste|listar|qual\s+(e|é|foi)|reveal|show|print|repeat)\b[^.\n]{0,60}\b(system\s*prompt|prompt\s+do\s+sistema|prompt\s+de\s+sistema|suas?\s+instru\w+|instru\w+\s+(do\s+)?(sistema|internas|iniciais|acima)|seu\s+prompt|configura\w+\s+interna)\b",
    "extracao_de_segredo": r"(?iU)(api[_\s-]?key|openai[_\s-]?api|chave\s+(de\s+)?api|token\s+de\s+acesso|\bcredencia\w+|\bsenhas?\b|\bpassword\b|\bsecret\b|\bvari[aá]ve(l|is)\s+de\s+ambiente|\benv\s+var\w*|\.env\b)",
    "tentativa_de_sql": r"(?isU)\b(select\s+.{0,40}\bfrom\b|insert\s+into|update\s+\w+\s+set|delete\s+from|drop\s+(table|view|database)|truncate\s+table|alter\s+table|create\s+(table|view)|union\s+(all\s+)?select|attach\s+database|pragma\s+\w+|;\s*--|'\s*or\s+'?1'?\s*=\s*'?1)",
    "execucao_de_codigo": r"(?iU)\b(exec\s*\(|eval\s*\(|os\.system|subprocess|__import__|rm\s+-rf|shutdown\b|curl\s+http)",
    "alteracao_de_metrica": r"(?iU)\b(mude|mudar|altere|alterar|ajuste|ajustar|troque|trocar|defina|definir|force|for[cç]ar|finja|fingir|informe|reporte|relate|diga\s+que|escreva\s+que|use\s+o\s+valor|considere\s+que)\b[^.\n]{0,80}\b(taxa|letalidade|mortalidade|indicador\w*|m[eé]trica\w*|ocupa\w+|cobertura|incid[eê]ncia|numerador|denominador|valor\s+d[aoe]|percentual)\b",
    "supressao_de_limitacao": r"(?iU)\b(omita|omitir|remova|remover|suprima|suprimir|n[aã]o\s+(mencione|cite|inclua|declare|escreva))\b[^.\n]{0,60}\b(limita\w+|ressalva\w*|disclaimer|aviso\w*|vi[eé]s|incerteza\w*|indisponibilidade)\b",
    "marcacao_de_papel": r"(?im)(</?(system|assistant|user|human|im_start|im_end)>|<\|[^|>]{0,30}\|>|^\s*(system|assistant)\s*:)",
}
INJECTION_MEDIUM = {
    "linguagem_imperativa_sobre_o_agente": r"(?iU)\b(a\s+partir\s+de\s+agora|de\s+agora\s+em\s+diante|from\s+now\s+on|sua\s+nova\s+(tarefa|fun[cç][aã]o|regra))\b",
    "bloco_de_codigo_na_solicitacao": r"(```|~~~)",
}
# Requests for treatment and for records of persons.
CLINICAL = (
    r"(?iU)\b(qual|que)\s+(remedio|medicamento|antibiotico|antiviral)\b",
    r"(?iU)\bcomo\s+(tratar|curar|medicar)\b",
    r"(?iU)\b(prescrev|receit)\w*\b",
    r"(?iU)\b(dose|dosagem|posologia)\s+(de|para|recomendad)\w*",
    r"(?iU)\b(diagnostic\w+|diagnóstic\w+)\s+(d[eo]|para)\s+(mim|paciente|meu|minha)",
    r"(?iU)\b(devo|posso)\s+(tomar|usar|aplicar|interromper)\b",
    r"(?iU)\bestou\s+com\b.*\b(sintoma|febre|tosse|falta de ar)\b",
    r"(?iU)\bmeu\s+(filho|pai|mae|marido|paciente)\b",
    r"(?iU)\b(medicament\w*|remedi\w*|antivir\w*|antibiotic\w*|tratamento\w*|terapia\w*)\s+(sao\s+|e\s+|é\s+|mais\s+)?(indicad\w*|recomendad\w*|adequad\w*|eficaz\w*)",
    r"(?iU)\b(sugira|sugere|indique|recomende)\s+(um\s+|o\s+)?(tratamento|medicament|remedi|terapia)",
    r"(?iU)\b(protocolo|esquema)\s+(de\s+)?(tratamento|medicacao|terapeutic\w*)\b",
    r"(?iU)\bcomo\s+(devo|posso)\s+(me\s+)?(tratar|medicar|cuidar)\b",
)
INDIVIDUAL = (
    r"(?iU)\b(registro|dado|caso|lista|nome|prontuario)s?\s+(individua\w*|nominai\w*|pessoai\w*)",
    r"(?iU)\b(nome|cpf|cns|endereco|endereço|telefone|prontuario)s?\s+(d[eo]s?\s+)?(paciente|obito|óbito|caso)s?",
    r"(?iU)\b(mostre|liste|revele|exiba|retorne|traga)\s+(os\s+|as\s+)?(pacientes|obitos|óbitos|pessoas)\s+que\b",
    r"(?iU)\bquem\s+(morreu|faleceu|foi\s+internad\w*)\b",
    r"(?iU)\b(revele|mostre|exiba)\s+.*\b(registros?|dados?)\s+individua\w*",
)
# Outputs that prescribe, connectives of cause, and ways to name a source.
PRESCRIPTIVE = (
    r"(?iU)\brecomend\w*(?:-se)?\s+(o uso|administrar|prescrever|tomar|iniciar)\b",
    r"(?iU)\b(deve|devem|deveria)\s+(tomar|usar|administrar|receber)\s+\w*(medicament|antivir|antibiotic|oseltamivir|tamiflu)\w*",
    r"(?iU)\b(prescrev|receit)\w*\b",
    r"(?iU)\bo\s+diagnostico\s+(e|é)\b",
    r"(?iU)\bdose\s+recomendada\b",
    r"(?iU)\b(usar|tomar|fazer\s+uso\s+de|iniciar)\s+(o\s+|os\s+|um\s+)?(antivir|antibiotic|oseltamivir|tamiflu|corticoid|medicament)\w*",
    r"(?iU)\b(e|é|esta|está)\s+(indicad|recomendad)\w*\s+(o\s+uso|a\s+administracao|iniciar|tratar)\b",
)
CAUSAL = (
    r"(?iU)\bdevido a\b",
    r"(?iU)\bpor causa de\b",
    r"(?iU)\bcausad[oa]\s+pel[oa]\b",
    r"(?iU)\bprovoc(ou|a|aram)\b",
    r"(?iU)\bem decorr[eê]ncia de\b",
    r"(?iU)\bcomo consequ[eê]ncia de\b",
    r"(?iU)\bfoi respons[aá]vel (por|pel[oa])\b",
    r"(?iU)\blevou (a|ao)\b",
)
ATTRIBUTION = (
    r"(?iU)\bsegundo\b|\bde acordo com\b|\bconforme\s+(a\s+|o\s+)?(noticia|notícia|reportagem|fonte)\w*",
    r"(?U)\b[A-ZÀ-Ú][\wÀ-ÿ]*(?:\s+[A-ZÀ-Ú][\wÀ-ÿ]*){0,3}\s+(informou|afirmou|declarou|divulgou|apontou|noticiou|reportou)\b",
)
NUMBER = r"(?<![\w/])-?\d{1,3}(?:\.\d{3})+(?:,\d+)?(?![\w/])|(?<![\w/])-?\d+,\d+(?![\w/])|(?<![\w/])-?\d+(?:\.\d+)?(?![\w/])"
PERCENT = r"^\s*(%|por\s+cento|pontos?\s+percentuais?|p\.p\.)"
# Topics and domains of news.
TOPICS = (
    "srag",
    "sindrome respiratoria",
    "sindrome respiratoria aguda grave",
    "insuficiencia respiratoria",
    "doenca respiratoria",
    "virus respiratorio",
    "influenza",
    "gripe",
    "h1n1",
    "h3n2",
    "covid",
    "coronavirus",
    "sars",
    "vsr",
    "sincicial",
    "pneumonia",
    "bronquiolite",
    "surto",
    "epidemia",
    "pandemia",
    "vacinacao",
    "vacina",
    "uti",
    "leitos",
    "internacao",
    "hospitalizacao",
)
DOMAINS = (
    "gov.br",
    "fiocruz.br",
    "butantan.gov.br",
    "who.int",
    "paho.org",
    "agenciabrasil.ebc.com.br",
    "ebc.com.br",
    "g1.globo.com",
    "globo.com",
    "folha.uol.com.br",
    "uol.com.br",
    "estadao.com.br",
    "oglobo.globo.com",
    "cnnbrasil.com.br",
    "bbc.com",
    "veja.abril.com.br",
    "abril.com.br",
    "correiobraziliense.com.br",
    "band.uol.com.br",
    "r7.com",
    "terra.com.br",
    "metropoles.com",
    "poder360.com.br",
    "nexojornal.com.br",
    "scielo.br",
    "usp.br",
    "unicamp.br",
    "ufrj.br",
)


def names_found(c: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found, in order."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(k)) for k, p in patterns.items())))


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return F.coalesce(out, F.lit(False))


def find_pii(c: Column) -> Column:
    """Kinds of personal data in a text, with ``segredo`` last; empty for null."""
    secret = F.when(any_of(c, SECRETS), F.array(F.lit("segredo"))).otherwise(F.array().cast("array<string>"))
    return F.concat(names_found(F.coalesce(c, F.lit("")), PII), secret)


def mask_pii(c: Column) -> Column:
    for p in (*PII.values(), *SECRETS):
        c = F.regexp_replace(c, p, MASK.replace("$", r"\$"))
    return c


def mask_map(c: Column) -> Column:
    """A map's values masked, whole where the key names a secret."""
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).rlike("|".join(SENSITIVE_KEYS)), F.lit(MASK)).otherwise(mask_pii(v)))


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which there is no built-in function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def beyond_ascii(c: Column, change) -> Column:
    """``change`` for the texts that hold more than ASCII; the others never reach Python."""
    return F.coalesce(change(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def strip_invisible(c: Column) -> Column:
    """In compatible forms (NFKC: full-width letters become plain ones), without control and format characters but for line ends and tabs."""
    return F.regexp_replace(beyond_ascii(c, compatible), r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")


def as_read(c: Column) -> Column:
    """A text, and what it reads as where that is another."""
    clean = strip_invisible(c)
    return F.when(clean == c, c).otherwise(F.concat(c, F.lit("\n"), clean))


def injection_findings(c: Column) -> Column:
    return names_found(as_read(c), INJECTION_HIGH | INJECTION_MEDIUM)


def injection_risk(c: Column) -> Column:
    x = as_read(c)
    return F.when(any_of(x, tuple(INJECTION_HIGH.values())), F.lit("alto")).when(any_of(x, tuple(INJECTION_MEDIUM.values())), F.lit("medio")).otherwise(F.lit("nenhum"))


def risk_of(findings: Column) -> Column:
    """The risk that names of findings stand for."""
    some = lambda names: F.arrays_overlap(findings, F.array(*map(F.lit, names)))
    return F.when(some(INJECTION_HIGH), F.lit("alto")).when(some(INJECTION_MEDIUM), F.lit("medio")).otherwise(F.lit("nenhum"))


def request_verdict(c: Column, risk: Column | None = None) -> Column:
    """What a request is refused for, first reason first; ``accepted`` if for none.  A risk that is known is not found again."""
    x = F.coalesce(strip(c), F.lit(""))
    return (
        F.when(x == "", F.lit("empty_request"))
        .when(any_of(x, INDIVIDUAL), F.lit("sensitive_data"))
        .when(any_of(x, CLINICAL), F.lit("medical_advice"))
        .when((injection_risk(x) if risk is None else risk) == "alto", F.lit("prompt_injection"))
        .otherwise(F.lit("accepted"))
    )


# What is made harmless in texts of unknown origin.
SANITIZE = (
    r"(?iU)\b(ignore|ignora|ignorar|desconsidere|esqueca|esqueça|disregard|forget)\b[^.\n]{0,40}\b(instru\w+|regra|prompt|acima|anterior\w*|previous|system)\b",
    r"(?iU)\b(voce|você|you)\s+(agora\s+)?(e|é|is|are)\s+(um|uma|a|an)\b[^.\n]{0,40}\b(assistente|agente|model|modo|mode)\b",
    r"(?iU)\b(novas?\s+instru\w+|new\s+instructions?|system\s*prompt|prompt\s+do\s+sistema)\b",
    r"(?iU)\b(revele|mostre|imprima|print|reveal|repeat)\b[^.\n]{0,30}\bprompt\b",
    r"(?iU)</?(system|assistant|user|instru\w+)>",
)
STRUCTURE, ROLE = r"(```|~~~|<\|[^|>]*\|>|\{\{|\}\})", r"(?im)^\s*(system|assistant|user|human|ai)\s*:"


def sanitize(c: Column, most: int = 200) -> tuple[Column, Column]:
    """A text of unknown origin made harmless, and what was found in it."""
    clean = strip_invisible(F.coalesce(c, F.lit("")))
    found = [F.when(F.length(clean) != F.length(F.coalesce(c, F.lit(""))), F.lit("caracteres_invisiveis"))]
    for p in SANITIZE:
        found.append(F.when(clean.rlike(p), F.lit("instrucao_embutida")))
        clean = F.regexp_replace(clean, p, "[trecho neutralizado]")
    for name, p in (("marcacao_de_prompt", STRUCTURE), ("rotulo_de_papel", ROLE)):
        found.append(F.when(clean.rlike(p), F.lit(name)))
        clean = F.regexp_replace(clean, p, " ")
    clean = F.trim(F.regexp_replace(clean, r"(?U)\s+", " "))
    short = F.when(F.length(clean) > most, F.concat(F.rtrim(F.substring(clean, 1, most - 3)), F.lit("..."))).otherwise(clean)
    return short, F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r"^www\.", "")


def trusted(c: Column) -> Column:
    """The host is one of DOMAINS or lies below one."""
    return F.coalesce(host(c).rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in DOMAINS) + ")$"), F.lit(False))


def canonical_url(c: Column) -> Column:
    path = F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    return F.regexp_replace(F.lower(F.concat(F.try_parse_url(c, F.lit("AUTHORITY")), path)), "/+$", "")


def publisher_url(declared: Column, link: Column) -> Column:
    return F.coalesce(declared, F.when(host(link).endswith("news.google.com"), F.try_parse_url(link, F.lit("QUERY"), F.lit("url"))), link)


def safe_url(c: Column) -> Column:
    """Scheme and host alone; null unless both are plain."""
    scheme, at = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))), F.lower(F.regexp_replace(F.try_parse_url(c, F.lit("AUTHORITY")), "^.*@", ""))
    return F.when(scheme.isin("http", "https") & at.rlike(r"^[a-z0-9.\-:]+$"), F.concat(scheme, F.lit("://"), at))


def normal_title(c: Column) -> Column:
    """Lower case without accents (NFKD), everything but letters, digits and spaces as a space."""
    return F.trim(F.regexp_replace(F.lower(beyond_ascii(c, fold)), "[^a-z0-9 ]+", " "))


def article_id(title: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat(normal_title(title), F.lit("|"), canonical_url(url)), 256), 1, 16)


def on_topic(title: Column) -> Column:
    """One of TOPICS stands in the title as whole words."""
    return normal_title(title).rlike("(^| )(" + "|".join(TOPICS) + ")( |$)")


def snippet(c: Column, most: int = 280) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")), 1, most)


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def numbers(c: Column) -> Column:
    """Numbers as written."""
    return F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))


def parse_number(raw: Column) -> Column:
    """``1.234,5`` and ``1234.5``; a single group of three digits behind a point is thousands."""
    local = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    joined = F.replace(raw, F.lit("."), F.lit(""))
    points = F.length(raw) - F.length(joined)
    return F.when(F.contains(raw, F.lit(",")), local).when((points > 1) | raw.rlike(r"^-?\d{1,3}\.\d{3}$"), joined).otherwise(raw).try_cast("double")


def close(a: Column, b: Column) -> Column:
    """Within 0.051, or from 1,000 on within a thousandth."""
    gap, scale = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    return (gap <= 0.051) | ((scale >= 1000.0) & (gap <= scale * 0.001))


def benign(n: Column) -> Column:
    """Whole numbers that need no evidence: 0 to 31 and the years 2019 to 2030."""
    return (F.floor(n) == n) & (F.abs(n).between(0, 31) | F.abs(n).between(2019, 2030))
