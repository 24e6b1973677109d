"""Search tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: token grammar ---------------------------------------------------------------------------------
WORD = "[0-9A-Za-z가-힣]+"
TOKEN = f"{WORD}(?:[&+./_-]{WORD})*\\+?"
SEPARATORS = "[&+./_-]+"


def base_tokens(text: Column) -> Column:
    """Lower-cased tokens; abbreviations such as ``t&d`` stay whole."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def token_aliases(token: Column) -> Column:
    """Other spellings of one token: the compact form, then its parts.  Empty for a plain word."""
    compact = F.regexp_replace(token, SEPARATORS, "")
    parts = F.filter(F.split(token, SEPARATORS), lambda p: p != "")
    return F.concat(F.array(compact), parts)


def search_tokens(text: Column) -> Column:
    """Every token with its aliases, as one array per row (no shuffle)."""
    base = base_tokens(text)
    joined = F.filter(base, lambda t: t.rlike(SEPARATORS))
    return F.concat(base, F.flatten(F.transform(joined, token_aliases)))
