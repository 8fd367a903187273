"""Personal data: base patterns, and a semi-Markov CRF that finds further spans.

The base patterns (email, ip, card, phone) are fixed and their spans always stay.
The CRF works on islands: the surroundings of digits and at signs, spelt ones too, cut into
atoms (runs of letters, runs of digits, single other characters, white space).
Every run of at most ``MAX_ATOMS`` atoms is a candidate segment of every kind,
scored by features of the whole span (its digit groups, separators, checksum,
what stands around it); other atoms are outside, one at a time. The segmental
forward-backward recursions sum over all segmentations, so boundaries and kinds
are chosen jointly. Atoms far from a trigger can only be outside, so cutting the
text into islands loses nothing.

Weights are fitted here, by gradient steps on the conditional likelihood of
generated islands (written in many formats, among look-alikes such as dates,
versions, times, prices and hex keys). A found segment counts if it is on the
best path, its marginal probability is at least ``MIN_MARGINAL``, and it overlaps
no base span.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltext.llm.bytetext import bounded_batches, released

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 21
MAX_SPAN = 80
MIN_MARGINAL = 0.9

#: The base patterns, fixed values.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LONG_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The email pattern's matches, found from the at signs: a match starts
    with the whole run of local characters before its sign, as far as the
    match before it leaves them. A plain search would start at every word."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := HOST.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) in code points per kind, in the order of ``KINDS``."""
    emails = list(_emails(text)) if "@" in text else []
    ips, cards, phones = [], [], []
    if text.isalpha():
        return [emails, ips, cards, phones]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            ips.append(m.span())
    if LONG_DIGITS.search(text):
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                cards.append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                phones.append(m.span())
    return [emails, ips, cards, phones]


# The model.

ATOM = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_DOT_WORDS, _AT_WORDS = ("dot", "."), ("at", "@")
_CUES = {
    "email": ("mail", "email", "contact", "write", "e-mail"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "payment", "credit"),
    "phone": ("call", "phone", "tel", "fax", "mobile", "dial", "ph", "cell"),
}
N_FEATURES = 16


def _sep_group(span: str) -> tuple[list[str], str]:
    groups = re.findall(r"[0-9]+", span)
    return groups, re.sub(r"[0-9]+", "", span)


def features(kind: str, text: str, start: int, end: int) -> np.ndarray | None:
    """Whole-span features of a candidate segment, or None if the span cannot
    be of the kind at all (its score would be minus infinity)."""
    span = text[start:end]
    if span[0].isspace() or span[-1].isspace() or len(span) > MAX_SPAN or "\n" in span:
        return None
    f = np.zeros(N_FEATURES)
    f[0] = 1
    groups, rest = _sep_group(span)
    digits = "".join(groups)
    before, after = text[start - 1 : start], text[end : end + 1]
    f[1] = before.isalnum() or after.isalnum()
    f[2] = before in tuple(".-/:$€£#_") and before != "" or (after in tuple("/-:%_") and after != "")
    cue = re.findall(r"[a-z-]+", text[max(0, start - 24) : start].lower())[-2:]
    f[3] = any(c in _CUES[kind] for c in cue)
    if kind == "email":
        low = re.sub(r"\s*[\[({]\s*(at|dot)\s*[\])}]\s*", r" \1 ", span.lower())
        m = re.fullmatch(r"([a-z0-9._%+-]+)( at |@| @ )([a-z0-9-]+(?:( dot |\.| \. )[a-z0-9-]+)+)", low)
        if not m:
            return None
        f[4] = "@" in span
        f[5] = " dot " in low
        f[6] = bool(re.search(r"[\[({](at|dot)[\])}]", span.lower().replace(" ", "")))
        f[7] = len(re.split(r" dot |\.| \. ", m[3])[-1]) in (2, 3) or m[3].endswith("info")
        f[8] = m[1] in ("the", "is", "was", "be", "and", "it", "or", "not")
        return f
    if not digits or not span[-1].isdigit() or not (span[0].isdigit() or span[0] in "+("):
        return None
    if kind == "ip":
        if span[0] in "+(" or not re.fullmatch(r"[0-9]{1,3}(\s?(\.|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}", span):
            return None
        f[4] = all(int(g) <= 255 for g in groups)
        f[5] = "[" in span or "(" in span
        f[6] = any(len(g) > 1 and g[0] == "0" for g in groups)
        f[7] = " " in span
        return f
    if not re.fullmatch(r"[0-9+(][0-9 ()./\-+]*", span) or len(groups) > 8:
        return None
    sizes = [len(g) for g in groups]
    if kind == "card":
        if not 12 <= len(digits) <= 19 or "+" in span or "(" in span or re.search(r"[^0-9]{2}", span):
            return None
        f[4] = luhn(digits)
        f[5] = len(digits) in (15, 16)
        f[6] = sizes in ([4, 4, 4, 4], [4, 6, 5])
        f[7] = len(groups) == 1
        f[8] = len(set(rest)) == 1
        return f
    if not 7 <= len(digits) <= 15 or len(groups) == 1 and span[0] != "+" or re.search(r"[^0-9()]{3}", span):
        return None
    f[4] = span[0] == "+"
    f[5] = "(" in span and ")" in span
    f[6] = sizes[-1] == 4 or sizes[-2:] == [2, 2]
    f[7] = 10 <= len(digits) <= 12
    f[8] = len(set(rest.replace(" ", ""))) <= 1
    f[9] = "/" in span
    f[10] = sizes in ([4, 2, 2], [2, 2, 4], [1, 2, 4]) or (len(groups) >= 3 and sizes[0] == 4 and groups[0][:2] in ("19", "20"))
    f[11] = "." in rest and all(s <= 3 for s in sizes)
    f[12] = sizes[-3:] == [3, 3, 4]
    f[13] = len(groups) >= 4 and all(s == 4 for s in sizes)
    return f


#: Separators that a span of digits may hold: cards and phones, addresses.
_CARD_PHONE, _ADDRESS = frozenset(" ()./-+"), frozenset(".[]()")


def _segments(text: str, atoms: list[tuple[int, int]]) -> list[tuple[int, int, int, np.ndarray]]:
    """(first atom, atom after the last, kind, features) of all candidates.

    What ``features`` refuses by the number of digits, of their groups and of dots
    or by a separator is known while a span grows, so it is asked only about
    the others, and a span of digits ends where none of its kinds can go on."""
    out = []
    word = [text[a:b] for a, b in atoms]
    digit, at = [w[0].isdigit() and w.isascii() for w in word], [w.lower() in _AT_WORDS for w in word]
    for i, w in enumerate(word):
        if w[0].isspace() or not (w[0].isalnum() or w[0] in "+(._%-"):
            continue
        has_at = False
        numeric = w[0].isdigit() or w[0] in "+("
        number = address = numeric  # whether a card or phone, or an ip, can still begin here
        address = address and w[0] not in "+("
        digits = groups = dots = 0
        for j in range(i, min(len(atoms), i + MAX_ATOMS)):
            word_j = word[j]
            has_at |= at[j]
            if atoms[j][1] - atoms[i][0] > MAX_SPAN:
                break
            if digit[j]:
                digits, groups = digits + len(word_j), groups + 1
                address = address and groups <= 4 and len(word_j) <= 3
                number = number and groups <= 8 and digits <= 19
            elif word_j[-1].isspace():
                if "\n" in word_j:
                    break
                number = number and not word_j.strip(" ")
                address = address and len(word_j) <= 2
                continue
            else:
                dots += word_j == "."
                number = number and word_j in _CARD_PHONE
                address = address and word_j in _ADDRESS and dots <= 3
            if has_at and j > i:
                if (f := features("email", text, atoms[i][0], atoms[j][1])) is not None:
                    out.append((i, j + 1, 0, f))
            if numeric and digit[j] and (number or address):
                fits = (False, address and groups == 4 and dots == 3, number and digits >= 12, number and 7 <= digits <= 15)
                for k in (1, 2, 3):
                    if fits[k] and (f := features(KINDS[k], text, atoms[i][0], atoms[j][1])) is not None:
                        out.append((i, j + 1, k, f))
    return out


def _lse(x: list[float]) -> float:
    m = max(x)
    return m + float(np.log(sum(np.exp(v - m) for v in x)))


def _inference(n: int, segs: list[tuple[int, int, int, np.ndarray]], w: np.ndarray) -> tuple[list[float], list[tuple[int, int, int]], float]:
    """(marginal of each candidate, best path's segments, log partition). An
    outside atom scores 0."""
    score = [float(w[k] @ f) for _, _, k, f in segs]
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for s, (i, j, _, _) in enumerate(segs):
        ends.setdefault(j, []).append(s)
        starts.setdefault(i, []).append(s)
    alpha, best, back = [0.0] * (n + 1), [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        alpha[j], best[j] = alpha[j - 1], best[j - 1]
        if j in ends:
            alpha[j] = _lse([alpha[j - 1], *(alpha[segs[s][0]] + score[s] for s in ends[j])])
            for s in ends[j]:
                if best[segs[s][0]] + score[s] > best[j]:
                    best[j], back[j] = best[segs[s][0]] + score[s], s
    beta = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        beta[i] = beta[i + 1]
        if i in starts:
            beta[i] = _lse([beta[i + 1], *(beta[segs[s][1]] + score[s] for s in starts[i])])
    marginal = [float(np.exp(alpha[i] + score[s] + beta[j] - alpha[n])) for s, (i, j, _, _) in enumerate(segs)]
    path, j = [], n
    while j > 0:
        s = back[j]
        if s < 0:
            j -= 1
        else:
            path.append(s)
            j = segs[s][0]
    return marginal, path[::-1], alpha[n]


def training_islands(seed: int = 11, n: int = 700) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated islands with their true spans (start, end, kind number)."""
    r = random.Random(seed)
    words = "the of to please see about on for with order number from at note is and or by".split()
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))

    def card():
        d = r.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", " ", "-", " "])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {num(2)} {num(4)} {num(4)}", f"+1-{a}-{b}-{c}", f"+{num(2)}{num(9)}", f"1-{a}-{b}-{c}"])

    def ip():
        p = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice([".", ".", ".", "[.]"]).join(p)

    def email():
        host, end = name(), r.choice(["com", "org", "net", "de", "fr", "io"])
        return r.choice([f"{name()}@{host}.{end}", f"{name()}.{name()}{num(2)}@{host}.{end}", f"{name()} [at] {host} [dot] {end}", f"{name()} at {host} dot {end}", f"{name()}(at){host}.{end}", f"{name()} @ {host}.{end}"])

    def other():
        hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 32, 40])))
        return r.choice([
            f"{r.randint(1990, 2030)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)}:{num(2)}", f"{num(1)}.{num(1)}.{num(2)}", f"{num(1)}.0", hexes, f"${num(3)}.{num(2)}", num(8), num(20),
            f"{r.randint(256, 999)}.{num(1)}.{num(3)}.{r.randint(256, 999)}", f"{name()} at {name()}", f"{name()} at {name()}. {name()}", num(16), f"{num(3)} {num(3)}", f"{num(4)} {num(4)}", f"{num(2)}.{num(2)}.{num(4)}", f"@{name()}", f"{num(3)}-{num(2)}",
            f"{num(4)} {num(4)} {num(4)}", f"{num(5)}-{num(4)}", f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}", f"{num(1)}, {num(1)}, {num(2)}", f"{num(3)}.{num(3)}", f"{num(3)} {num(4)}",
        ])

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(r.choice(words) for _ in range(r.randint(1, 4))) + " "
            k = r.choice([0, 1, 2, 3, 4, 4, 4])
            if k < 4 and r.random() < 0.3:
                text += r.choice(_CUES[KINDS[k]]) + r.choice([" ", ": "])
            value = (email, ip, card, phone, other)[k]()
            if k < 4:
                spans.append((len(text), len(text) + len(value), k))
            text += value + r.choice([" ", ", ", ". ", "; ", "!! "])
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=1)
def fitted_weights(steps: int = 120, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (kinds x features) that maximise the conditional likelihood of the
    generated islands: observed minus expected features, by Adagrad."""
    w, seen = np.zeros((4, N_FEATURES)), np.full((4, N_FEATURES), 1e-6)
    w[:, 0] = -2
    cases = []
    for text, truth in training_islands():
        atoms = [m.span() for m in ATOM.finditer(text)]
        segs = _segments(text, atoms)
        if segs:
            gold = [(a, b, k) in truth for a, b, k in ((atoms[i][0], atoms[j - 1][1], k) for i, j, k, _ in segs)]
            cases.append((len(atoms), segs, gold))
    for _ in range(steps):
        g = -decay * len(cases) * w
        for n, segs, gold in cases:
            marginal, _, _ = _inference(n, segs, w)
            for s, (_, _, k, f) in enumerate(segs):
                g[k] += (float(gold[s]) - marginal[s]) * f
        g /= len(cases)
        seen += g * g
        w = w + rate * g / np.sqrt(seen)
    return w


#: Every candidate holds a match: a digit, an at sign, a bracketed "at", or " at" before a
#: bracket or before a host's first label and what ``features`` may read as its dot.
DIGIT_OR_AT = re.compile(r"[0-9@]+|[\[({]\s*at\s*[\])}]| at(?=\s*[\[({]| [a-z0-9-]+(?: ?\.| dot|\s*[\[({]\s*dot))", re.I)


def islands(text: str) -> list[tuple[int, int]]:
    """Where a segment may be: ``MAX_SPAN`` characters around digits, at signs and
    spelt ones, joined where they touch."""
    out: list[tuple[int, int]] = []
    for m in DIGIT_OR_AT.finditer(text):
        a, b = max(0, m.start() - MAX_SPAN), min(len(text), m.end() + MAX_SPAN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _crf_spans(text: str, w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the segments the CRF finds."""
    found = []
    for a, b in islands(text):
        atoms = [m.span() for m in ATOM.finditer(text, a, b)]
        segs = _segments(text, atoms)
        if not segs:
            continue
        marginal, path, _ = _inference(len(atoms), segs, w)
        for s in path:
            if marginal[s] >= MIN_MARGINAL:
                i, j, k, _ = segs[s]
                found.append((atoms[i][0], atoms[j - 1][1], k))
    return found


def spans(text: str, w: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]:
    """(base spans per kind, further spans (start, end, kind number))."""
    base = base_spans(text)
    if not (DIGIT_OR_AT.search(text)):
        return base, []
    taken = sorted(s for one in base for s in one)
    more = []
    for a, b, k in _crf_spans(text, w):
        if not any(x < b and a < y for x, y in taken):
            more.append((a, b, k))
    return base, more


def _joined(items: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(items))


def _finder(weights, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in released(batches):
            rows = []
            for text in batch.column(text_col).to_pylist():
                base, more = spans(text or "", w)
                first = [(k, a, b) for k in range(4) for a, b in base[k]]
                rows.append((*map(len, base), _joined(first), _joined(first + [(k, a, b) for a, b, k in more])))
            cols = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6)]
            keep = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != text_col]
            yield pa.RecordBatch.from_arrays([c for _, c in keep] + cols, [n for n, _ in keep] + ["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return run


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of every row.

    ``docs`` has doc_id and text; other columns are ignored. The counts and
    ``base`` are of the base patterns, ``spans`` also holds what the CRF adds;
    both are ``kind:start:end`` (code points, end exclusive) by kind as listed,
    then start, joined by commas. A null or empty text has no spans. Rows are
    judged one by one, so repeated rows are equal; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    w = docs.sparkSession.sparkContext.broadcast(fitted_weights())  # 64 floats
    out = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("pii_text"))
    kind = out.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(_finder(w, "pii_text"), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def mask_text(text: str | None, w: np.ndarray) -> str | None:
    """The text with every span replaced by its kind in angle brackets. Spans of
    several kinds that overlap are replaced together, by the first one's kind."""
    if not text:
        return text
    base, more = spans(text, w)
    found = sorted([(a, b, k) for k in range(4) for a, b in base[k]] + more)
    if not found:
        return text
    parts, at, end = [], 0, 0
    for a, b, k in found:
        if a >= end:
            parts += [text[at:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
        at = end
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text_col`` masked; all other columns and all
    rows stay as they are, repeated ones too. Nulls stay null, empty texts empty; an
    empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    w = docs.sparkSession.sparkContext.broadcast(fitted_weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            at = batch.schema.names.index(text_col)
            masked = pa.array([mask_text(t, w.value) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([masked if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
