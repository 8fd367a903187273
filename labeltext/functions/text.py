"""Column -> Column text functions (JVM-side, whole-stage codegen friendly).

Python's ``str.strip()``, ``str.split()`` and ``re`` ``\\s`` use Unicode
whitespace; Java's ``\\s`` and Spark's ``trim`` do not. The explicit classes
below make the JVM behave like Python on every character that matters, and the
same classes (rewritten for RE2) are used by the DuckDB oracle.
"""

from __future__ import annotations

import html
import html.entities
import re
import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _class(chars: str) -> str:
    """A regex character class written with escapes only (Java syntax).

    Code points below 256 stay single (Java folds them into one bit-set
    lookup); higher ones are merged into ranges (one predicate each).
    """
    cps = sorted({ord(c) for c in chars})
    parts, i = [], 0
    while i < len(cps):
        j = i
        if cps[i] >= 256:
            while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
                j += 1
        parts.append(f"\\u{cps[i]:04x}" if i == j else f"\\u{cps[i]:04x}-\\u{cps[j]:04x}")
        i = j + 1
    return "[" + "".join(parts) + "]"


# Whitespace exactly as Python's str.isspace() / str.split() / str.strip(),
# and line boundaries as str.splitlines(): enumerated from Python itself.
WS_CHARS = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())
LB_CHARS = "".join(chr(i) for i in range(sys.maxunicode + 1)
                   if len(f"a{chr(i)}b".splitlines()) == 2)
WS = _class(WS_CHARS)
LB = "(?:\\r\\n|" + _class(LB_CHARS) + ")"

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's patterns for right results).
# Control characters replaced by clean_text.
CONTROL_CHARS = "".join(chr(i) for i in [*range(0x00, 0x20), *range(0x7F, 0xA0)])
# Structural tags replaced by a space before all other tags.
BLOCK_TAG = r"<WS*(?:br|p|div|li)WS*/?WS*>"
ANY_TAG = r"<[^>]+>"
# Prefixes removed from generated answers, then characters stripped.
ANSWER_PREFIX = r"^(?:skill category|skill_name|skill name|answer|response)WS*:WS*"
ANSWER_STRIP_CHARS = " \t\n\r\"'`.,;:"
EMPTY_PREDICTION = "[empty]"
MISSING_TEXT = "nan"
# ---------------------------------------------------------------------------

CONTROL = _class(CONTROL_CHARS)
BLOCK_TAG = BLOCK_TAG.replace("WS", WS)
ANSWER_PREFIX = ANSWER_PREFIX.replace("WS", WS)
# Runs that "whitespace runs -> one space" would change: two or more, or a
# single non-space character. A lone ' ' is left alone (no per-match cost).
SPACE_RUN = f"{WS}{{2,}}|{_class(WS_CHARS.replace(' ', ''))}"
_BLANKISH = "".join(sorted(set(WS_CHARS) | set(CONTROL_CHARS)))
BLANK_RUN = f"{_class(_BLANKISH)}{{2,}}|{_class(_BLANKISH.replace(' ', ''))}"


def to_re2(pattern: str) -> str:
    """Rewrite a Java pattern for RE2 (DuckDB): ``\\uhhhh`` -> ``\\x{hhhh}``."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", pattern)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- STR3 entity decoding ----------------------------------------------------

# Code points that a numeric reference may not name: dropped, or replaced by
# what Windows-1252 has at 0x80-0x9F (its five holes stay as they are).
REPLACEMENT = "\ufffd"
C1_MEANING = "".join(bytes([i]).decode("cp1252", "replace").replace(REPLACEMENT, chr(i)) for i in range(0x80, 0xA0))
NAME = "^[^\t\n\f <&#;]{1,32};?"


# Names that also count without ';', and as the beginning of a longer word.
LEGACY = {n: c for n, c in html.entities.html5.items() if not n.endswith(";")}
# A name's characters are one or two; tables give them two places.
FILLER = "\uffff"


def _name_table(names: dict[str, str]) -> str:
    """The names as one text in which a name is found by a byte search."""
    return "\n" + "\n".join(f"{n}\t{c.ljust(2, FILLER)}" for n, c in names.items()) + "\n"


ALL_NAMES, LEGACY_NAMES = _name_table(html.entities.html5), _name_table(LEGACY)


def bind(col: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once. Catalyst inlines a column wherever it is
    named and evaluates it anew in each branch of a CASE; a lambda's variable
    is evaluated once."""
    return F.get(F.transform(F.array(col), body), 0)


def _sql_string(s: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" if c in "'\\$\n\t" else c for c in s) + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _meaning(name: str, table: str) -> str:
    """SQL: the characters of a name; NULL if the table has no such name."""
    found = _let("place", f"instr(names, concat('\\n', {name}, '\\t'))",
                 f"if(place > 0, rtrim('{FILLER}', substr(names, place + length({name}) + 2, 2)), NULL)")
    return _let("names", _sql_string(table), found)


def _unescape_sql() -> str:
    """The body of the SQL function: the text ``t`` is cut at every '&' and the
    parts behind one are decoded, each by itself.

    A number: '#', 'x' before hexadecimal digits, any number of zeros; code points
    beyond Unicode, surrogates and 0 are U+FFFD, 0x80-0x9F as in C1_MEANING,
    other control characters and noncharacters are dropped. A name: the whole
    one, else the longest beginning that counts without ';', else left as it is.
    """
    dropped = "(n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n & 65535 >= 65534)"
    character = (f"CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN '{REPLACEMENT}' "
                 f"WHEN n BETWEEN 128 AND 159 THEN substr({_sql_string(C1_MEANING)}, n - 127, 1) "
                 f"WHEN {dropped} THEN '' ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END")
    value = ("CASE WHEN digits = '' THEN 0 WHEN length(digits) > 7 THEN 1114112 "
             "WHEN substr(sign, 2, 1) IN ('x', 'X') THEN CAST(conv(digits, 16, 10) AS INT) ELSE CAST(digits AS INT) END")
    digits = "ltrim('0', substr(sign, if(substr(sign, 2, 1) IN ('x', 'X'), 3, 2)))"
    rest = "substr(part, length(sign) + if(substr(part, length(sign) + 1, 1) = ';', 2, 1))"
    number = _let("sign", "regexp_extract(part, '^#(?:[0-9]+|[xX][0-9a-fA-F]+)', 0)",
                  f"if(sign = '', concat('&', part), concat({_let('n', _let('digits', digits, value), character)}, {rest}))")
    begins = f"transform(sequence({max(map(len, LEGACY))}, 2), k -> concat({_meaning('substr(name, 1, k)', LEGACY_NAMES)}, substr(name, k + 1)))"
    named = _let("name", f"regexp_extract(substr(part, 1, 33), {_sql_string(NAME)}, 0)",
                 f"concat(coalesce({_meaning('name', ALL_NAMES)}, get(filter({begins}, x -> x IS NOT NULL), 0), concat('&', name)), "
                 "substr(part, length(name) + 1))")
    part = (f"CASE WHEN startswith(part, 'amp;') THEN concat('&', substr(part, 5)) WHEN startswith(part, '#') THEN {number} "
            f"WHEN substr(part, 1, 1) IN ('', '\\t', '\\n', '\\u000c', ' ', '<', ';') THEN concat('&', part) ELSE {named} END")
    whole = f"concat(parts[0], array_join(transform(slice(parts, 2, size(parts)), part -> {part}), ''))"
    return f"if(instr(t, '&') = 0, t, {_let('parts', "split(t, '&')", whole)})"


UNESCAPE = "labeltext_unescape_html"


def unescape_html(col: Column | str) -> Column:
    """STR3: ``html.unescape`` on the JVM, exact for all names, the names that
    count without ';' (also as a beginning), and decimal and hexadecimal numbers.

    Every reference is decoded once, so that ``&amp;lt;`` becomes ``&lt;``. Texts
    without '&' are passed through. The expression is a temporary SQL function of the active
    session, made at its first use: building it call by call
    through Py4J took half a second for every column.
    """
    spark = SparkSession.active()
    if not getattr(spark, "_" + UNESCAPE, False):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {UNESCAPE}(t STRING) RETURNS STRING RETURN {_unescape_sql()}")
        setattr(spark, "_" + UNESCAPE, True)
    return F.call_function(UNESCAPE, _c(col))


@F.pandas_udf(StringType())
def unescape_html_exact(s: pd.Series) -> pd.Series:
    """The standard library's ``html.unescape`` in Arrow batches, as a cross-check."""
    return s.map(lambda v: v if v is None else html.unescape(v))


# --- generic helpers ---------------------------------------------------------

def py_strip(col: Column | str) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends."""
    return F.trim(_c(col), F.lit(WS_CHARS))


def _runs_to_space(col: Column, chars: str) -> Column:
    """Every run of characters from ``chars`` (which holds ' ') becomes one
    space: each other character is mapped to ' ' by ``translate`` (a
    per-character table lookup), then runs of spaces are collapsed by the
    simplest regex. Same result as one regex over the character class, about
    4x faster on long text (measured on documents at sf0.1)."""
    others = chars.replace(" ", "")
    return F.regexp_replace(F.translate(col, others, " " * len(others)), " {2,}", " ")


def collapse_ws(col: Column | str) -> Column:
    """``re.sub(r"\\s+", " ", s)``."""
    return _runs_to_space(_c(col), WS_CHARS)


def as_text(col: Column | str) -> Column:
    """``str(value)`` for a pandas cell: missing becomes ``'nan'``."""
    return F.coalesce(_c(col).cast("string"), F.lit(MISSING_TEXT))


# --- STR2 clean_text --------------------------------------------------------

def decode_entities(col: Column | str, entities: str = "auto") -> Column:
    """STR3 by tier: ``auto`` (default) decodes on the JVM, ``exact`` by the
    standard library in Python workers. Both give the same text."""
    if entities == "auto":
        return unescape_html(col)
    if entities == "exact":
        return unescape_html_exact(_c(col))
    raise ValueError(f"unknown entities tier: {entities!r}")


def clean_text(col: Column | str, entities: str = "auto") -> Column:
    """Remove markup, control characters and repeated whitespace; blank -> NULL.

    Order: decode entities, block tags -> space, any tag -> space, control
    characters -> space, whitespace runs -> one space, strip. The two tag
    passes run only on values that contain a ``<`` (a byte search), since
    each regex pass copies the value to UTF-16 and back.
    """
    def without_tags(text: Column) -> Column:
        tags = F.regexp_replace(F.regexp_replace(text, "(?i)" + BLOCK_TAG, " "), ANY_TAG, " ")
        return F.when(F.instr(text, "<") > 0, tags).otherwise(text)

    # control characters -> space, then whitespace runs -> one space: runs of
    # (control | whitespace) become one space.
    text = py_strip(_runs_to_space(bind(decode_entities(col, entities), without_tags), _BLANKISH))
    return bind(text, lambda t: F.nullif(t, F.lit("")))


# --- STR4 / STR5 lengths ----------------------------------------------------

def char_count(col: Column | str) -> Column:
    """``len(s)`` in code points."""
    return F.length(_c(col))


def word_count(col: Column | str) -> Column:
    """``len(s.split())`` for any text; NULL stays NULL."""
    return F.coalesce(word_count_clean(F.nullif(py_strip(collapse_ws(_c(col))), F.lit(""))),
                      F.when(_c(col).isNotNull(), F.lit(0)))


def word_count_clean(col: Column | str) -> Column:
    """Word count of non-empty text with single spaces between words (as
    produced by ``clean_text``): spaces + 1, counted by bytes, no array."""
    c = _c(col)
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1).cast("int")


# --- STR7 normalize_label ---------------------------------------------------

def normalize_label(col: Column | str) -> Column:
    """``str`` -> strip -> lower -> whitespace runs to one space -> drop '.' ->
    ``\\s*,\\s*`` to ``', '``. Not stripped again (``'a .'`` -> ``'a '``)."""
    text = F.lower(py_strip(as_text(col)))
    text = collapse_ws(text)
    text = F.replace(text, F.lit("."), F.lit(""))
    return F.regexp_replace(text, f"{WS}*,{WS}*", ", ")


# --- STR9 clean_prediction --------------------------------------------------

def first_nonblank_line(col: Column | str) -> Column:
    """First line (``str.splitlines``) that is not blank, stripped; NULL if none."""
    lines = F.transform(F.split(_c(col), LB), lambda x: py_strip(x))
    return F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1))


def clean_prediction(col: Column | str) -> Column:
    """Keep one label from generated text; ``'[empty]'`` when nothing is left."""
    text = py_strip(as_text(col))
    text = F.regexp_replace(text, "(?i)" + ANSWER_PREFIX, "")
    line = first_nonblank_line(text)
    line = F.trim(line, F.lit(ANSWER_STRIP_CHARS))
    return F.coalesce(F.nullif(line, F.lit("")), F.lit(EMPTY_PREDICTION))


# --- STR10 correctness flags ------------------------------------------------

def labels_match(truth: Column | str, prediction: Column | str,
                 mode: str = "normalized") -> Column:
    """Correct flag: ``normalized`` (default), ``raw`` equality, or ``casefold``
    (strip + lower)."""
    if mode == "normalized":
        return normalize_label(truth) == normalize_label(prediction)
    if mode == "raw":
        return F.coalesce(_c(truth) == _c(prediction), F.lit(False))
    if mode == "casefold":
        return F.lower(py_strip(as_text(truth))) == F.lower(py_strip(as_text(prediction)))
    raise ValueError(f"unknown match mode: {mode!r}")
