"""Personal data: exact base patterns, and spans added by a semi-Markov conditional random field.

The base patterns find e-mail addresses, IP addresses, card and phone numbers. The field scores whole
spans (their shape, length, checksum, alphabet and neighbours) against leaving their units alone, and a
dynamic program over the units between base spans picks the boundaries and kinds together. A unit is a word
with what joins its letters and digits, of any length; a segment has at most LONGEST units, and at most
MAX_CHARS characters if it has more than one: the bounds of the model's segments. Besides the base kinds it
knows secrets (keys and tokens) and account numbers (long numbers that fail the card check). It is trained
here, by conditional likelihood, on seeded sentences that carry such data and look-alikes (versions, dates,
prices, identifiers, compound names).

Only words around a digit, an at-sign or a capital after a small letter can hold a span, and units outside
spans score nothing, so decoding these stretches one by one gives the same result as decoding the text.

Null text: empty, no spans. Null doc_id and repeated rows: each row has its result. Ties: the shorter segment
that starts later, then the kind listed first. Very long texts: every pattern and every walk over spans takes
time in proportion to the text. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import doc_text, pieces

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account")
Span = tuple[str, int, int]
Weights = dict[tuple[str, str], float]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]|[a-z][A-Z]")
SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: each at-sign with all of the local part before it and of the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        else:
            end = max(end, at + 1) if start == at else end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind and place."""
    out = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


#: A unit: letters and digits with what joins them, or one other character.
UNIT = re.compile(r"[^\W_](?:[\w.%+@-]*[^\W_])?|[^\s]")
LONGEST, CONTEXT, GAP = 8, 24, 40
MAX_CHARS = 128
HEX, BASE64 = re.compile(r"[0-9a-f]+"), re.compile(r"[0-9A-Za-z+/=_-]+")
Unit = tuple[int, int]


def units_of(text: str, start: int, end: int) -> list[Unit]:
    return [m.span() for m in UNIT.finditer(text, start, end)]


def _size(n: int) -> str:
    return str(n) if n < 8 else f"{n // 4 * 4}+" if n < 40 else "40+"


def span_features(text: str, start: int, end: int) -> list[str]:
    """What the field sees of a whole span; independent of its kind."""
    s = text[start:end]
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "0", re.sub(r"[^\W\d_]", "a", s)))[:14]
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    word = re.findall(r"[^\W\d_]+", text[max(0, start - CONTEXT) : start].lower())
    out = ["bias", f"shape={shape}", f"digits={_size(digits)}", f"letters={_size(letters)}", f"length={_size(len(s))}", f"glued={before.isalnum()}{after.isalnum()}", f"between={before if not before.isalnum() else 'w'}{after if not after.isalnum() else 'w'}"]
    if word:
        out.append(f"word={word[-1]}")
    if s.count("@") == 1:
        out.append(f"at={bool(DOMAIN.fullmatch(s.rpartition('@')[2]))}{set(s.partition('@')[0]) <= LOCAL and s[0] != '@'}")
    if digits == len(s) or not letters:
        out.append(f"number={_size(digits)}{s[0] == '+'}")
        if 13 <= digits <= 19:
            out.append(f"luhn={luhn(''.join(c for c in s if c.isdigit()))}")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) < 4 for p in parts):
        out.append(f"quad={all(int(p) <= 255 for p in parts)}")
    if digits and letters and len(s) >= 16:
        out.append(f"hex={bool(HEX.fullmatch(s))}{_size(len(s))}")
        out.append(f"alphabet={bool(BASE64.fullmatch(s))}{len(set(s)) >= 10}")
    elif letters and len(s) >= 16:
        turns = len(re.findall("[a-z][A-Z]", s))
        out.append(f"turns={min(turns, 4)}{bool(BASE64.fullmatch(s))}{turns * 8 >= len(s)}")
    return out


def candidates(text: str, units: list[Unit], barred: list[Unit] = ()) -> Iterator[tuple[int, int, list[str]]]:
    """(first unit, last unit + 1, features) of the spans that hold a trigger, touch no barred place and no blank line.

    ``barred``: places in ascending order, apart from one another.
    """
    hot = [bool(TRIGGER.search(text, a, b)) for a, b in units]
    shut, k = [], 0
    for a, b in units:
        while k < len(barred) and barred[k][1] <= a:
            k += 1
        shut.append(k < len(barred) and barred[k][0] < b)
    for i, (a, _) in enumerate(units):
        seen = False
        for j in range(i, min(i + LONGEST, len(units))):
            if shut[j] or (j > i and (units[j][1] - a > MAX_CHARS or units[j][0] - units[j - 1][1] > 1)):
                break
            seen = seen or hot[j]
            if seen:
                yield i, j + 1, span_features(text, a, units[j][1])


def _score(weights: Weights, kind: str, features: list[str]) -> float:
    return sum(weights.get((kind, f), 0.0) for f in features)


def decode(text: str, units: list[Unit], weights: Weights, barred: list[Unit] = ()) -> list[Span]:
    """The best segmentation: best[j] is the score of the first j units."""
    by_end: dict[int, list] = {}
    for i, j, features in candidates(text, units, barred):
        kind, score = max(((k, _score(weights, k, features)) for k in KINDS), key=lambda x: x[1])
        if score > 0:
            by_end.setdefault(j, []).append((i, kind, score))
    best, back = [0.0], [None]
    for j in range(1, len(units) + 1):
        here, how = best[j - 1], None
        for i, kind, score in by_end.get(j, ()):
            if best[i] + score > here:
                here, how = best[i] + score, (i, kind)
        best.append(here)
        back.append(how)
    out, j = [], len(units)
    while j:
        if back[j]:
            i, kind = back[j]
            out.append((kind, units[i][0], units[j - 1][1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """The words that hold triggers, those at most GAP characters apart together."""
    start = end = None
    m = TRIGGER.search(text)
    while m:
        a, before = m.start(), end or 0
        while a > before and not text[a - 1].isspace():
            a -= 1
        space = SPACE.search(text, m.end())
        b = space.start() if space else len(text)
        if end is not None and a - end > GAP:
            yield start, end
            start = None
        start, end = a if start is None else start, b
        m = TRIGGER.search(text, b)
    if end is not None:
        yield start, end


def union(spans: list[Span]) -> list[Unit]:
    """The places that spans cover, in ascending order, apart from one another."""
    out: list[Unit] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find(text: str, weights: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, both by kind and place."""
    base = base_spans(text)
    covered, k = union(base), 0
    more: list[Span] = []
    for a, b in stretches(text):
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        last = k
        while last < len(covered) and covered[last][0] < b:
            last += 1
        more += decode(text, units_of(text, a, b), weights, covered[k:last])
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + more, key=lambda s: (order[s[0]], s[1]))


# Training: seeded sentences, conditional likelihood by stochastic gradient.

SYLLABLES = "re th on an er ti in es ha st ou ie la de ch que ver ge ado ción el".split()
LEADS = {"email": ["mail", "contact", "to", "write"], "ip": ["host", "from", "ip", "server"], "card": ["card", "visa", "paid"], "phone": ["call", "phone", "tel"], "secret": ["token", "key", "secret", "password", "api_key"], "account": ["account", "number", "card", "acct"]}


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _number(r: random.Random, valid: bool) -> str:
    while luhn(s := _digits(r, r.choice([13, 15, 16, 16, 16]))) != valid:
        pass
    return s if r.random() < 0.7 or len(s) != 16 else r.choice(" -").join(s[i : i + 4] for i in range(0, 16, 4))


def _example(r: random.Random, kind: str) -> str:
    if kind == "email":
        return f"{_word(r)}{r.choice(['.', '_', '-', ''])}{_digits(r, r.randint(0, 2))}@{_word(r)}{_digits(r, r.randint(0, 1))}.{r.choice(['example.com', 'org', 'example.net', 'co.uk'])}"
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "phone":
        return r.choice([f"+1 ({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"+{r.randint(20, 99)} {_digits(r, 3)} {_digits(r, 4)} {_digits(r, 3)}", f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}"])
    if kind == "secret":
        n = r.choice([24, 32, 40, 40, 64, 200])
        if r.random() < 0.15:  # letters alone
            return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(n))
        return "".join(r.choice(r.choice(["0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])) for _ in range(n)) if r.random() < 0.3 else "".join(r.choice("0123456789abcdef") for _ in range(n))
    return _number(r, kind == "card")


def _look_alike(r: random.Random) -> str:
    return r.choice([
        f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 30)}", f"{r.randint(1900, 2030)}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        f"{r.randint(1, 23)}:{r.randint(10, 59)}", f"${r.randint(1, 999)}.{r.randint(10, 99)}", f"#{_digits(r, r.randint(3, 7))}", _digits(r, r.randint(1, 11)), f"{_word(r)}{r.randint(1, 99)}", f"@{_word(r)}", f"{r.randint(1, 99)}%",
        f"{r.randint(256, 999)}.{r.randint(300, 999)}.{r.randint(1, 999)}.{r.randint(1, 999)}", f"{r.randint(1, 9)},{_digits(r, 3)},{_digits(r, 3)}", f"{_digits(r, 3)}-{_digits(r, 2)}",
        "".join(_word(r).capitalize() for _ in range(r.randint(2, 6))), _word(r) + "".join(_word(r).capitalize() for _ in range(r.randint(1, 5))),
    ])


def sentence(r: random.Random) -> tuple[str, list[Span]]:
    """A sentence and its gold spans."""
    text, spans = "", []
    for _ in range(r.randint(2, 4)):
        text += " ".join(_word(r) for _ in range(r.randint(1, 4))) + " "
        if r.random() < 0.5:
            text += _look_alike(r) + " "
            continue
        kind = r.choice(KINDS)
        if r.random() < 0.4:
            text += r.choice(LEADS[kind]) + r.choice([" ", ": ", " = "])
        quote = '"' if kind == "secret" and r.random() < 0.6 else ""
        value = _example(r, kind)
        spans.append((kind, len(text) + len(quote), len(text) + len(quote) + len(value)))
        text += quote + value + quote + r.choice([" ", ". ", ", ", "### ", "*** "])
    return text + _word(r), spans


def _gradient(text: str, gold: list[Span], weights: Weights) -> dict[tuple[str, str], float]:
    """Gold minus expected feature counts, by the forward-backward recursion over segments."""
    units = units_of(text, 0, len(text))
    rows = [(i, j, k, f, _score(weights, k, f)) for i, j, f in candidates(text, units) for k in KINDS]
    starts, ends = {}, {}
    for row in rows:
        starts.setdefault(row[0], []).append(row)
        ends.setdefault(row[1], []).append(row)
    add = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
    n = len(units)
    front, rear = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        front[j] = add([front[j - 1], *(front[r[0]] + r[4] for r in ends.get(j, ()))])
    for i in range(n - 1, -1, -1):
        rear[i] = add([rear[i + 1], *(rear[r[1]] + r[4] for r in starts.get(i, ()))])
    true, out = set(gold), {}
    for i, j, k, features, score in rows:
        step = ((k, units[i][0], units[j - 1][1]) in true) - math.exp(front[i] + score + rear[j] - front[n])
        if abs(step) > 1e-4:
            for f in features:
                out[k, f] = out.get((k, f), 0.0) + step
    return out


_trained: dict[tuple[int, int, int], Weights] = {}


def train(sentences: int = 240, rounds: int = 4, seed: int = 11) -> Weights:
    """Weights by AdaGrad over the seeded sentences."""
    key = (sentences, rounds, seed)
    if key not in _trained:
        r, weights, seen = random.Random(seed), {}, {}
        data = [sentence(r) for _ in range(sentences)]
        for _ in range(rounds):
            r.shuffle(data)
            for text, gold in data:
                for f, g in _gradient(text, gold, weights).items():
                    seen[f] = seen.get(f, 1e-3) + g * g
                    weights[f] = weights.get(f, 0.0) + 0.4 * g / math.sqrt(seen[f])
        _trained[key] = weights
    return _trained[key]


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                counts, digests, spans, added = [], [], [], []
                for text in part.column("text").to_pylist():
                    base, everything = find(text, weights.value)
                    kinds = [s[0] for s in base]
                    counts.append([kinds.count(k) for k in BASE_KINDS])
                    digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                    spans.append(spans_text(everything))
                    added.append(len(everything) - len(base))
                columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE_KINDS))]
                columns += [pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (kind:start:end of all), n_added, n_spans."""
    weights = docs.sparkSession.sparkContext.broadcast(train())
    schema = ", ".join(["doc_id long", *(f"n_{k} long" for k in BASE_KINDS), "base_sha256 string", "spans string", "n_added long"])
    found = doc_text(docs).mapInArrow(_found(weights), schema)
    return found.withColumn("n_spans", F.col("n_added") + sum((F.col(f"n_{k}") for k in BASE_KINDS), F.lit(0)))
