"""Column functions for symbols, terms and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_symbol(c: Column) -> Column:
    """A text as a symbol: blanks and - . , : become _, all but letters, digits and _ goes, lower case.

    Null becomes ``null``, nothing left ``unknown``; a leading digit gets an ``n``.
    """
    kept = F.regexp_replace(F.regexp_replace(c, r"[ .,:-]", "_"), "[^a-zA-Z0-9_]", "")
    named = F.when(kept == "", "unknown").when(kept.rlike("^[0-9]"), F.concat(F.lit("n"), kept)).otherwise(kept)
    return F.coalesce(F.lower(named), F.lit("null"))


def sanitize_list(c: Column) -> Column:
    """An array of texts as one symbol, its parts joined by two underscores."""
    return F.array_join(F.transform(c, sanitize_symbol), "__")


def sanitize_symbol_short(c: Column, most: int = 50) -> Column:
    """The variant that turns every other sign into _, prefixes digits with x and cuts."""
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_")
    return F.substring(F.when(plain.rlike("^[0-9]"), F.concat(F.lit("x"), plain)).otherwise(plain), 1, most)


def parse_term(c: Column) -> Column:
    """struct(negated, functor, args) of texts like ``not(p(a,b))`` or ``p``."""
    text = F.trim(c)
    negated = text.rlike(r"^not\s*\(")
    inner = F.when(negated, F.regexp_extract(text, r"(?s)^not\s*\((.*)\)\s*$", 1)).otherwise(text)
    functor = F.trim(F.regexp_extract(inner, r"^\s*([^(]*)", 1))
    args = F.regexp_extract(inner, r"(?s)\((.*)\)", 1)
    parts = F.filter(F.transform(F.split(args, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(negated.alias("negated"), functor.alias("functor"), parts.alias("args"))


def role_from_var(var: Column, head_args: Column) -> Column:
    """Which role a variable has by its place in the head: agent, patient, argN (from 3), or unknown."""
    at = F.coalesce(F.array_position(head_args, var), F.lit(0))
    return F.when(at == 0, "unknown").when(at == 1, "agent").when(at == 2, "patient").otherwise(F.concat(F.lit("arg"), at.cast("string")))


def quote(c: Column, most: int) -> Column:
    """A quote in one line with its double quotes escaped, cut to ``most`` characters."""
    return F.substring(F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit('\\"')), 1, most)


def prompt(template: str, limits: dict[str, int], **values: Column) -> Column:
    """The template with each {name} filled in by a column cut to its limit."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.substring(F.coalesce(value, F.lit("")), 1, limits.get(name, 2**31 - 1)))
    return out
