"""Text helpers for evidence: PII masking, injection neutralization, sentences and citations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from watchtide import fixed
from watchtide.functions.core import any_of


def redact_pii(text: Column) -> Column:
    """Mask e-mail addresses and the last octet of IPv4 addresses."""
    masked = F.regexp_replace(text, fixed.EMAIL_PATTERN, fixed.EMAIL_TOKEN)
    return F.regexp_replace(masked, fixed.IPV4_PATTERN, "$1.xxx")


def neutralize(text: Column) -> Column:
    """Replace instruction-like passages.  Each pattern sees the text the earlier ones left."""
    for pattern in fixed.INJECTION_PATTERNS:
        text = F.regexp_replace(text, "(?i)" + pattern, F.lit(fixed.INJECTION_TOKEN))
    return text


def sanitize(text: Column, limit: int | None = None) -> Column:
    """Struct (clean, flagged, left_out): masked and neutralized text, and whether any pattern was found.

    With ``limit`` the text is cut to so many characters and ``left_out`` counts those behind.
    """
    masked = redact_pii(text)
    clean = neutralize(masked)
    kept = clean if limit is None else F.substring(clean, 1, limit)
    return F.struct(kept.alias("clean"), F.coalesce(clean != masked, F.lit(False)).alias("flagged"),
                    (F.length(clean) - F.length(kept)).alias("left_out"))


def sentences(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def citations(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.CITATION_PATTERN), F.lit(1))


def mentions(text: Column, patterns: list[str]) -> Column:
    return any_of([text.rlike("(?i)" + p) for p in patterns])
