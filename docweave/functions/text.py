"""Text: folding, tokens, lines, titles, names, anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token of the lexical ranking. Trailing . : / - stay in it. The letters that are most frequent stand first, as they are tried in this order; the set is that of [\p{L}\p{N}_À-ÿ].
TOKEN = r"[a-z0-9_\p{L}\p{N}À-ÿ][a-z0-9_\p{L}\p{N}À-ÿ./:-]*"
#: Fixed value: a word of claims and claim questions.
WORD = r"[\p{L}\p{N}_]+"
#: Fixed value: what ends a line: CR LF together, or one of CR, LF, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"


def casefold(text: Column) -> Column:
    """Full case folding as far as ß goes, the only letter of de, en, es and fr that folds to two; others are lowered."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def token_list(text: Column) -> Column:
    return F.regexp_extract_all(casefold_safe(text), F.lit(TOKEN), F.lit(0))


def casefold_safe(text: Column) -> Column:
    return casefold(F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """Distinct folded tokens, in order of appearance; null text has none."""
    return F.array_distinct(token_list(text))


def claim_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(casefold_safe(text), F.lit(WORD), F.lit(0)))


def lines(text: Column) -> Column:
    """The lines of a text without their ends. A last line end starts no new line; empty and null texts have no lines."""
    t = F.coalesce(text, F.lit(""))
    all_ = F.split(t, LINE_END, -1)
    trimmed = F.when(F.element_at(all_, -1) == "", F.slice(all_, 1, F.size(all_) - 1)).otherwise(all_)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(trimmed)


#: Fixed value: a level-one heading.
TITLE = r"^\s*#\s+(.+?)\s*$"


def markdown_title(text: Column, fallback: Column) -> Column:
    """The first level-one heading, else ``fallback``."""
    first = F.try_element_at(F.filter(lines(text), lambda x: F.regexp_like(x, F.lit(TITLE))), F.lit(1))
    return F.coalesce(F.trim(F.regexp_extract(first, TITLE, 1)), fallback)


def file_stem(path: Column) -> Column:
    """The name of a file without its last suffix; a leading dot is no suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(casefold_safe(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "documentation").otherwise(s)


def normalise_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(casefold_safe(text), "[^a-z0-9]+", " "))


#: Fixed value: accented letters of the supported languages and what they become without accents.
ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŸ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"


def heading_anchor(text: Column) -> Column:
    """The anchor of a heading: markup dropped, accents dropped, other non-ASCII and odd characters too, lower case, blanks to hyphens."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[`*_~]", "")
    t = F.regexp_replace(F.translate(t, ACCENTED, PLAIN), r"[^a-zA-Z0-9 -]", "")
    return F.regexp_replace(F.lower(F.trim(t)), r" +", "-")


#: Words that decide where a question is sent.
ROUTE_LIFECYCLE = r"(?i)\b(add|approve|change|delete|index|ingest|modify|publish|reconcile|register|remove|revoke|rollback|update)\b"
ROUTE_LITERAL = r"(?i)\b(default|defaults|signature|endpoint|version|changelog|exact|literal|parameter|config(?:uration)?)\b"
ROUTE_CONCEPTUAL = r"(?i)\b(how|why|pattern|concept|conceptual|guide|best practice|trade-?off|design)\b"


def route_query(query: Column) -> Column:
    """lifecycle, both, rag or skill: verbs that change state first, then literal and conceptual words."""
    q = F.coalesce(query, F.lit(""))
    literal, conceptual = F.regexp_like(q, F.lit(ROUTE_LITERAL)), F.regexp_like(q, F.lit(ROUTE_CONCEPTUAL))
    return F.when(F.regexp_like(q, F.lit(ROUTE_LIFECYCLE)), "lifecycle").when(literal & conceptual, "both").when(literal, "rag").otherwise("skill")
