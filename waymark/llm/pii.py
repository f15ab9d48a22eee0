"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The base finds emails, IP addresses, payment cards and phone numbers by their patterns, on whole texts, in time that
grows with the length of the text. The field then looks at the stretches that hold digits or an at sign: every run
of tokens there whose shape fits a kind is a candidate segment, within the bounds of an entity: ``LONGEST`` tokens,
``MOST_GROUPS`` groups of digits, the digits of its kind. Features of the whole segment (groups, separators, digits,
Luhn, word before) give it a score; a dynamic program over the tokens picks the segments, their boundaries and kinds
together, against leaving tokens out. Segments that overlap no base span are added. All of this takes time in
proportion to the text, however long its words, numbers and lists of numbers.

The field's weights are learned by maximum likelihood, with exact gradients from the forward-backward recursion, on
lines made from a seed: numbers and addresses written in many ways, among dates, prices, versions and codes.

Defined results: a null text is empty; a text without personal data has no spans (the digest of the empty string);
repeated rows are searched each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.workers import tidy

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, kind's place in KINDS

# Fixed: the base patterns. Lookbehinds only spare starts that can't match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and kind."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out.append((start, end, 0))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# The field.

_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|[^0-9A-Za-z\s]")
#: Bounds of an entity: tokens in all, and groups of digits of a number.
LONGEST, MOST_GROUPS = 32, 6
_AT = re.compile(r"\s?(?:@|[(\[]at[)\]])\s?")
_DOT = r"(?:\.|\s?[(\[]dot[)\]]\s?)"
_WRITTEN_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
#: Seven digits with little between them, or four short groups with dots between them.
_NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[().\x20/-]{0,2}[0-9]){6,}|(?<![0-9])[0-9]{1,3}(?:(?:\s?\.\s?|\s?[(\[]dot[)\]]\s?)[0-9]{1,3}){3}")
_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$")
#: Words that announce a kind.
_CUES = {
    "tel": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "cell": "phone", "fax": "phone", "text": "phone", "whatsapp": "phone",
    "email": "email", "mail": "email", "contact": "email", "write": "email",
    "card": "card", "visa": "card", "mastercard": "card", "amex": "card", "credit": "card", "debit": "card",
    "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "ping": "ip",
}
_SHAPE_EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*\s?(?:@|[(\[]at[)\]])\s?[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}")
_SHAPE_IP = re.compile(r"(?:[0-9]{1,3}(?:\.|\s?[(\[]dot[)\]]\s?|\s\.\s?)){3}[0-9]{1,3}")
_GOES_ON = re.compile(r"[.\[(@]\w|\s[(\[](?:dot|at)[)\]]")
_DIGITS = "0123456789"
_MASK = str.maketrans(_DIGITS, "0" * 10)


def stretches(text: str) -> list[tuple[int, int]]:
    """Where personal data may be, in order and apart: round an at sign (written out, too), and numbers.

    Found from anchors outwards, so that the time grows with the length of the text whatever it holds.
    """
    mails: list[tuple[int, int]] = []
    end = 0
    for m in _AT.finditer(text):
        if m.start() >= end and (domain := _WRITTEN_DOMAIN.match(text, m.end())):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = domain.end()
                mails.append((start, end))
    out, at = [], 0
    for start, end in [*mails, (len(text), len(text))]:
        out += [m.span() for m in _NUMBERS.finditer(text, at, start)]
        if start < end:
            out.append((start, end))
        at = end
    return out


def _around(text: str, start: int, end: int) -> tuple[str, str, bool, str | None]:
    """The signs before and after a segment, whether it goes on behind that, and the kind that a word before announces."""
    left, right = text[start - 1 : start], text[end : end + 1]
    before = _BEFORE.search(text[max(0, start - 24) : start])
    return left, right, _GOES_ON.match(text, end) is not None, _CUES.get(before[1].lower()) if before else None


def _named(kind: int, around: tuple, names: list[str]) -> list[str]:
    left, right, goes_on, cue = around
    common = ["bias", f"edge:{left.isalnum()}{right.isalnum()}", f"goes on:{goes_on}", f"cue:{cue == KINDS[kind]}", f"other cue:{cue is not None and cue != KINDS[kind]}"]
    return [f"{KINDS[kind]} {n}" for n in [*common, *names]]


@lru_cache(1 << 16)
def _number(shape: str, zero: bool, sound: bool, around: tuple) -> list[tuple[int, list[str]]]:
    """Kinds and features of a number, all digits of which are masked: with what it starts, and its Luhn sum, aside."""
    groups = [len(g) for g in re.findall("0+", shape)]
    n, between = sum(groups), "".join(sorted({c for c in shape if c != "0"}))
    left, right = around[:2]
    out = []
    if 13 <= n <= 19:
        out.append((2, _named(2, around, [f"luhn:{sound}", f"sep:{between}", f"fours:{all(g == 4 for g in groups[:-1])}", f"one:{len(groups) == 1}", f"length:{n}"])))
    if 7 <= n <= 15:
        beside = f"beside:{left in tuple('.,/-:#$')}{right in tuple('/-:%')}"
        out.append((3, _named(3, around, [f"plus:{shape[0] == '+'}", f"paren:{'(' in shape}", f"balanced:{shape.count('(') == shape.count(')')}", f"sep:{between}", f"shape:{'-'.join(map(str, groups))}", f"digits:{n}", f"groups:{len(groups)}", f"zero:{zero}", beside])))
    return out


Segment = tuple[int, int, int, list[str]]  # first token, last + 1, kind, features


def _lattice(text: str, start: int, end: int) -> tuple[list[int], list[Segment]]:
    """Token boundaries of a stretch, and its candidate segments."""
    bounds = [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]
    tokens = [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    segments: list[Segment] = []
    digits = [i for i, t in enumerate(tokens) if t[0] in _DIGITS]
    for nth, last in enumerate(digits):
        to, size = bounds[last + 1], 0
        for groups in range(1, min(MOST_GROUPS, nth + 1) + 1):
            i = digits[nth + 1 - groups]
            if groups > 1 and tokens[i + 1 : digits[nth + 2 - groups]] and not all(t in tuple("()./-") or not t.strip(" ") for t in tokens[i + 1 : digits[nth + 2 - groups]]):
                break
            size += len(tokens[i])
            if size > 19:
                break
            if size >= 7:
                for first in range(i, max(-1, i - 3), -1):
                    if first < i and tokens[first] not in ("+", "("):
                        break
                    if last - first < LONGEST:
                        s = text[bounds[first] : to]
                        sound = 13 <= size and luhn("".join(filter(str.isdigit, s)))
                        segments += [(first, last + 1, kind, names) for kind, names in _number(s.translate(_MASK), tokens[i][0] == "0", sound, _around(text, bounds[first], to))]
        i = digits[nth - 3] if nth >= 3 else last
        if 0 < last - i < LONGEST and _SHAPE_IP.fullmatch(text, bounds[i], to):
            parts, around = [tokens[d] for d in digits[nth - 3 : nth + 1]], _around(text, bounds[i], to)
            names = [f"range:{max(map(int, parts)) <= 255}", f"zeros:{any(len(p) > 1 and p[0] == '0' for p in parts)}", f"small:{max(map(int, parts)) < 20}", f"dotted:{'.' in around[:2]}", f"spaced:{' ' in text[bounds[i] : to]}"]
            segments.append((i, last + 1, 1, _named(1, around, names)))
    for m in _AT.finditer(text, start, end):
        a, b = bisect_left(bounds, m.start()), bisect_left(bounds, m.end())
        for i in range(a - 1, max(-1, a - LONGEST), -1):
            if not (tokens[i][0] in _LOCAL):
                break
            for j in range(b + 1, min(len(tokens), i + LONGEST) + 1):
                if tokens[j - 1].isalpha() and _SHAPE_EMAIL.fullmatch(text, bounds[i], bounds[j]):
                    s = text[bounds[i] : bounds[j]]
                    names = [f"plain:{'@' in s}", f"spaced:{' ' in s}", f"written:{'at' in s and '@' not in s}", f"cut:{text[bounds[i] - 1 : bounds[i]] in tuple('._%+-')}"]
                    segments.append((i, j, 0, _named(0, _around(text, bounds[i], bounds[j]), names)))
    return bounds, segments


def _decoded(bounds: list[int], segments: list, weights: dict[str, float]) -> list[Span]:
    """The best segmentation; on ties, tokens are left out."""
    n = len(bounds) - 1
    best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(0.0, 0, -1)] * n
    by_end: dict[int, list] = {}
    for s in segments:
        by_end.setdefault(s[1], []).append(s)
    for j in range(1, n + 1):
        now = (best[j - 1][0], j - 1, -1)
        for i, _, kind, names in by_end.get(j, ()):
            score = best[i][0] + sum(weights.get(x, 0.0) for x in names)
            if score > now[0]:
                now = (score, i, kind)
        best[j] = now
    out, j = [], n
    while j:
        _, i, kind = best[j]
        if kind >= 0:
            out.append((bounds[i], bounds[j], kind))
        j = i
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi))


def _gradient(bounds: list[int], segments: list, truth: set[Span], weights: dict[str, float]) -> dict[str, float]:
    """Observed less expected features, by forward and backward sums over all segmentations."""
    n = len(bounds) - 1
    score = [sum(weights.get(x, 0.0) for x in s[3]) for s in segments]
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for k, s in enumerate(segments):
        by_end.setdefault(s[1], []).append(k)
        by_start.setdefault(s[0], []).append(k)
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1]
        for k in by_end.get(j, ()):
            ahead[j] = _log_add(ahead[j], ahead[segments[k][0]] + score[k])
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for k in by_start.get(i, ()):
            behind[i] = _log_add(behind[i], behind[segments[k][1]] + score[k])
    out: dict[str, float] = {}
    for k, (i, j, kind, names) in enumerate(segments):
        seen = (bounds[i], bounds[j], kind) in truth
        change = seen - math.exp(ahead[i] + score[k] + behind[j] - ahead[n])
        if abs(change) > 1e-6:
            for x in names:
                out[x] = out.get(x, 0.0) + change
    return out


def _made(seed: int, lines: int) -> list[tuple[str, set[Span]]]:
    """Lines with spans, from a seed."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice((12, 14, 14, 14)))
        full = next(body + c for c in "0123456789" if luhn(body + c))
        cut = rng.choice((" ", "-", "", ".", "", " "))
        return cut.join(full[i : i + 4] for i in range(0, len(full), 4))

    def phone() -> str:
        a, b, c = str(rng.randint(2, 9)) + digits(2), digits(3), digits(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"0{digits(1)} {b} {c}", f"00{rng.randint(20, 99)} {digits(2)} {b} {c}", f"0{digits(3)} {digits(6)}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}"))

    def email() -> str:
        at, dot = rng.choice((("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", ".")))
        return f"{word()}{rng.choice(('', '.' + digits(2), '_' + word()))}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', f'co{dot}uk'))}"

    def ip() -> str:
        return rng.choice((".", ".", " . ", "[dot]")).join(str(rng.randint(0, 255)) for _ in range(4))

    def decoy() -> str:
        y, m, d = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28)
        return rng.choice((
            f"{y}-{m:02}-{d:02}", f"{d:02}/{m:02}/{y}", f"{d:02}.{m:02}.{y}", f"{y}{m:02}{d:02}", f"{y}-{m:02}-{d:02} {rng.randint(10, 23)}", f"{digits(3)},{digits(3)}.{digits(2)}",
            f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", digits(rng.randint(7, 13)), digits(rng.choice((16, 16, 20, 24))), f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}",
            f"{rng.randint(300, 999)}.{digits(3)}.{digits(3)}.{digits(3)}", f"{y}-{y + 1}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(5)}-{digits(4)}", f"{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}",
            f"{digits(2)} {digits(3)} {digits(1)} {digits(4)}", f"{word()}@{word()}", f"{digits(4)}/{digits(4)}", f"{digits(1)}.{digits(8)}", f"{digits(3)}-{digits(2)}-{digits(3)}",
            f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"979-{digits(2)}-{digits(4)}-{digits(3)}-{digits(1)}",
        ))

    cues = {k: [c for c, v in _CUES.items() if v == k] for k in KINDS}
    out = []
    for _ in range(lines):
        text, spans = " ".join(word() for _ in range(rng.randint(1, 4))), set()
        for _ in range(rng.randint(1, 2)):
            kind = rng.choice((0, 1, 2, 3, 3, None, None, None, None))
            value = decoy() if kind is None else (email, ip, card, phone)[kind]()
            lead = rng.choice(cues[KINDS[kind]]) + rng.choice((" ", ": ")) if kind is not None and rng.random() < 0.3 else ""
            text += " " + lead
            if kind is not None:
                spans.add((len(text), len(text) + len(value), kind))
            text += value + rng.choice((" ", ", ", ". ")) + " ".join(word() for _ in range(rng.randint(1, 3)))
        out.append((text, spans))
    return out


@lru_cache(1)
def weights(seed: int = 0, lines: int = 700, rounds: int = 6) -> dict[str, float]:
    """The field's weights: stochastic gradient ascent with AdaGrad steps and a small L2 penalty."""
    made = []
    for text, truth in _made(seed, lines):
        for start, end in stretches(text):
            bounds, segments = _lattice(text, start, end)
            if segments:
                known = {(s[0], s[1], s[2]) for s in truth}
                made.append((bounds, segments, known))
    rng = random.Random(seed)
    w: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(rounds):
        rng.shuffle(made)
        for bounds, segments, known in made:
            for x, g in _gradient(bounds, segments, known, w).items():
                g -= 1e-3 * w.get(x, 0.0)
                squares[x] = squares.get(x, 0.0) + g * g
                w[x] = w.get(x, 0.0) + 0.5 * g / math.sqrt(squares[x] + 1e-8)
    return w


def added(text: str, fixed: list[Span], w: dict[str, float]) -> list[Span]:
    """The field's segments that overlap none of the fixed spans."""
    if "@" not in text and "(at)" not in text and "[at]" not in text and not _DIGIT.search(text):
        return []
    held: list[list[int]] = []  # what the base has stays as it is; the field reads what lies beside it
    for start, end, _ in sorted(fixed):
        if held and start <= held[-1][1]:
            held[-1][1] = max(held[-1][1], end)
        else:
            held.append([start, end])
    out, k = [], 0
    for start, end in stretches(text):
        while k < len(held) and held[k][1] <= start:
            k += 1
        at = start
        while k < len(held) and held[k][0] < end:
            if held[k][0] > at:
                out += _decoded(*_lattice(text, at, held[k][0]), w)
            at = held[k][1]
            if at > end:
                break  # the next stretch may lie within it, too
            k += 1
        if at < end:
            out += _decoded(*_lattice(text, at, end), w)
    return out


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def found(docs: DataFrame) -> DataFrame:
    """For every row: counts of the base spans by kind, their digest, all spans, and how many the field added."""
    w = weights()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                t = text.as_py() or ""
                fixed = base(t)
                more = added(t, fixed, w)
                counts = [sum(s[2] == k for s in fixed) for k in range(4)]
                rows.append((*counts, hashlib.sha256(_listed(fixed).encode()).hexdigest(), _listed(fixed + more), len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(work), schema)
