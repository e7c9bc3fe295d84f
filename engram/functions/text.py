"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "㐀-䶿一-鿿"
#: Characters that count as one token each (ideographs, kana, hangul).
WIDE = "㐀-䶿一-鿿぀-ヿ가-힯"
TERM = rf"([a-z0-9_]+|[{CJK}]+)"
EMPTY = "cast(array() as array<string>)"


def fold(text: Column) -> Column:
    """Case folding as far as the tables need it: lower case, and the one letter whose fold is longer."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bigrams(token: Column) -> Column:
    return F.when(F.length(token) > 1, F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))).otherwise(F.expr(EMPTY))


def _is_cjk(token: Column) -> Column:
    return token.rlike(f"^[{CJK}]+$")


def lexical_terms(text: Column, cap: int = 8) -> Column:
    """Terms of a query in order: Latin tokens and runs of ideographs, each longer run followed by its bigrams.

    Reading stops when `cap` terms are there; a run that comes last still brings one bigram with it.
    """
    tokens = F.array_distinct(F.regexp_extract_all(fold(text), F.lit(TERM), 1))

    def add(out: Column, token: Column) -> Column:
        full = F.size(out) >= cap
        with_token = F.array_union(out, F.array(token))
        pieces = F.when(_is_cjk(token) & (F.length(token) > 2), bigrams(token)).otherwise(F.expr(EMPTY))
        room = F.greatest(F.lit(1), F.lit(cap) - F.size(with_token))
        return F.when(full, out).otherwise(F.concat(with_token, F.slice(F.array_except(pieces, with_token), F.lit(1), room)))

    return F.aggregate(tokens, F.expr(EMPTY), add)


def rerank_terms(text: Column) -> Column:
    """The set of terms for overlap: short runs of ideographs stay, longer ones give their bigrams only. Not capped."""
    tokens = F.regexp_extract_all(fold(text), F.lit(TERM), 1)
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.when(_is_cjk(t) & (F.length(t) > 2), bigrams(t)).otherwise(F.array(t)))))


def bounded(text: Column, cap: int) -> Column:
    """Head and tail of a long text around a mark; a short one as it is."""
    half = cap // 2
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, half), F.lit("\n...\n"), F.right(text, F.lit(half)))).otherwise(text)


def cut(text: Column, chars: int) -> Column:
    return F.rtrim(F.substring(text, 1, chars))


def wide_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{WIDE}]", ""))


def estimate_tokens(text: Column) -> Column:
    """One per wide character, a quarter for any other, rounded up."""
    wide = wide_count(text)
    return (wide + F.ceil((F.length(text) - wide) / 4)).cast("long")


def graph_token_cost(text: Column, path_length: Column) -> Column:
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]", ""))
    return F.greatest(F.lit(1), cjk + F.ceil((F.length(text) - cjk) / 4) + path_length * 80).cast("long")


#: What counts as a secret in chat text, in the order of replacement.
SECRETS = (
    r"(?im)\b(?:proxy-)?authorization\s*[:=]\s*[^\r\n]+",
    r"""(?i)['"]?[A-Za-z0-9_.-]*(?:authorization|api[_-]?key|access[_-]?token|refresh[_-]?token|token)['"]?\s*[:=]\s*(?:bearer\s+)?(?:['"][^'"\r\n]+['"]|[^\s,;}\]\r\n]+)""",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+",
    r"\bsk-[A-Za-z0-9_-]{12,}\b",
)


def redact(text: Column) -> Column:
    """Secrets in chat text replaced by [REDACTED]."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def query_focus(text: Column) -> Column:
    """What follows the last colon, if what stands before it says that the rest is all that is remembered."""
    normal = normalize_query(text)
    before, after = F.regexp_extract(normal, "^(.*)[：:](.*)$", 1), F.regexp_extract(normal, "^(.*)[：:](.*)$", 2)
    marked = F.exists(F.array(*map(F.lit, RECALL_MARKERS)), lambda m: F.contains(fold(before), m))
    return F.when((after != "") & marked, F.trim(after)).otherwise(normal)


#: Phrases that mark a query as a remembered fragment.
RECALL_MARKERS = ("只记得", "记不清", "结果或指标", "remember only")
