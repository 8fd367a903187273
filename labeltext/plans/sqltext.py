"""DuckDB SQL fragments for the oracle, built from the same fixed values as the
Spark Column functions (character classes rewritten for RE2)."""

from __future__ import annotations

from html.entities import html5

from ..functions import text as T

WS = T.to_re2(T.WS)
LB = T.to_re2(T.LB)
BLOCK_TAG = T.to_re2(T.BLOCK_TAG)
ANSWER_PREFIX = T.to_re2(T.ANSWER_PREFIX)
SPACE_RUN = T.to_re2(T.SPACE_RUN)
BLANK_RUN = T.to_re2(T.BLANK_RUN)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chars(s: str) -> str:
    """A string of arbitrary characters as an SQL expression (no raw controls)."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in s) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {chars(T.WS_CHARS)})"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, {lit(WS + '+')}, ' ', 'g')"


# The names the given tables use, and some more; SQL replaces them one by one,
# '&amp;' last.
SQL_ENTITIES = [
    "lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "trade", "middot", "mdash", "ndash", "hellip", "laquo", "raquo",
    "lsquo", "rsquo", "ldquo", "rdquo", "bull", "euro", "pound", "yen", "cent", "sect", "deg", "times", "divide",
    "plusmn", "para", "amp",
]


def unescape(x: str) -> str:
    out = x
    for name in SQL_ENTITIES:
        char = html5[name + ";"]
        if name in html5:
            out = f"regexp_replace({out}, {lit('&' + name + ';?')}, {lit(char)}, 'g')"
        else:
            out = f"replace({out}, {lit('&' + name + ';')}, {lit(char)})"
    return out


def clean_text(x: str) -> str:
    t = unescape(x)
    t = f"regexp_replace({t}, {lit(BLOCK_TAG)}, ' ', 'gi')"
    t = f"regexp_replace({t}, {lit(T.ANY_TAG)}, ' ', 'g')"
    t = strip(f"regexp_replace({t}, {lit(BLANK_RUN)}, ' ', 'g')")
    return f"nullif({t}, '')"


def word_count_clean(x: str) -> str:
    return f"len(string_split({x}, ' '))"


def word_count(x: str) -> str:
    s = strip(x)
    return f"CASE WHEN {s} = '' THEN 0 ELSE len(string_split_regex({s}, {lit(WS + '+')})) END"


def as_text(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'nan')"


def normalize_label(x: str) -> str:
    t = f"lower({strip(as_text(x))})"
    t = collapse(t)
    t = f"replace({t}, '.', '')"
    return f"regexp_replace({t}, {lit(WS + '*,' + WS + '*')}, ', ', 'g')"


def clean_prediction(x: str) -> str:
    t = strip(as_text(x))
    t = f"regexp_replace({t}, {lit(ANSWER_PREFIX)}, '', 'i')"
    lines = f"list_filter(list_transform(string_split_regex({t}, {lit(LB)}), lambda l: {strip('l')}), lambda l: l <> '')"
    line = f"{lines}[1]"
    line = f"trim({line}, {chars(T.ANSWER_STRIP_CHARS)})"
    return f"coalesce(nullif({line}, ''), {lit(T.EMPTY_PREDICTION)})"


def pair_key(*cols: str) -> str:
    """Tuple identity for GROUP BY / PARTITION BY (DuckDB compares NULLs equal there)."""
    return ", ".join(cols)
