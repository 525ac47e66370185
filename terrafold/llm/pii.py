"""Personal data by rules and by a semi-Markov conditional random field.

Rules find e-mail addresses, IP addresses, card and phone numbers in their usual
spelling (:func:`base_spans`); these spans always stay. The random field adds what
is spelled otherwise: ``name [at] host [dot] org``, ``10[.]0[.]0[.]1``, card
numbers parted by dots, phone numbers without a plus sign.

1. Only text near digits or an ``@`` or ``at`` can hold an entity. Such islands
   are cut into tokens; everywhere else the only label is "no entity", whose
   score is 0, so decoding the islands alone is exact.
2. Segments of at most ``MAX_TOKENS`` tokens, ``MAX_CHARS`` characters and ``MAX_GROUPS`` groups of digits are scored as
   wholes: digits, lengths of their groups, check digit, separators, form of an
   address, neighbours. Weights are per type and feature.
3. Dynamic programming over token boundaries picks boundaries and types together:
   the best sequence of segments and single tokens without entity. Segments that touch
   a rule's span are not offered. Time and memory are linear in the text.
4. Weights maximise the likelihood of labelled islands (forward and backward sums
   over all segmentations): spans that the rules find in a sample of documents, chosen by hash and bounded by
   ``SAMPLE_SPANS``, their other spellings, and numbers that are no personal
   data (dates, sums, versions, failing check digits), made by a fixed generator.

Defined cases: null texts are empty; empty texts have no spans; rows without id
and repeated rows are rows like others; offsets are code points, ends exclusive;
no rows give no rows; further columns are ignored by the search and kept by the masking.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_SPANS = 4_000, 160
MAX_TOKENS, MAX_CHARS = 24, 96  # of a segment; numbers also have at most MAX_GROUPS groups of digits
MAX_GROUPS = 6
MIN_MARGIN = 1.0  # by how much an entity must score above none
_EPOCHS, _RATE, _DECAY = 80, 0.5, 1e-4
#: Of every feature, for each kind.
Weights = dict[str, list[float]]
SPANS = "array<struct<kind:string,start:int,end:int>>"

# Possessive and anchored at the start of a run of digits, so long runs take linear time; the matches are those of the plain patterns.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the rules, by kind and start."""
    found, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            found.append(("email", start, done))
        else:
            done = at + 1
        at = text.find("@", done)
    if not re.search("[0-9]", text):
        return found
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


# Islands and segments

_TOKEN = re.compile(r"[0-9]+|[\[({<]\s?(?:at|AT|dot|DOT)\s?[\])}>]|\[\.\]|\(\.\)|[^\W\d_]+|\s+|.", re.DOTALL)
# Digits with at most five separators between them; an address with its marker.
_NUMBERS = re.compile(r"[+(]{0,2}[0-9]++(?:[  ().,/\[\]–-]{1,5}+[0-9]++)*+")
_MARK = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\sdot\s)"
_ADDRESS = re.compile(rf"{_MARK}(?=[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z0-9-])")
_DOMAIN_TAIL = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,6}}+")
_ADDRESS_FORM = re.compile(rf"([A-Za-z0-9._%+-]{{1,64}})({_MARK})([A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,6}}?{_DOT}([A-Za-z]{{2,24}}))")
_MORE = re.compile(rf"{_DOT}[A-Za-z0-9-]")
_NUMERIC = frozenset("0123456789  ().,/+-[]–")


def islands(text: str) -> list[tuple[int, int]]:
    """Ranges of the text that may hold an entity, with what is next to them; disjoint and in order."""
    raw = []
    for m in _NUMBERS.finditer(text):
        if sum(c in "0123456789" for c in m[0]) >= 4 and not (len(m[0]) < 9 and m[0].isdigit()):
            raw.append(m.span())
    if "@" in text or "at" in text or "AT" in text:
        for m in _ADDRESS.finditer(text):
            local = len(_LOCAL.search(text, max(0, m.start() - 64), m.start())[0])
            if local and (tail := _DOMAIN_TAIL.match(text, m.end())):
                raw.append((m.start() - local, tail.end()))
    out: list[list[int]] = []
    for a, b in sorted(raw):
        a, b = max(0, a - 2), min(len(text), b + 2)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _side(text: str, at: int) -> str:
    """Class of a neighbouring character."""
    if at < 0 or at >= len(text) or text[at].isspace():
        return "space"
    c = text[at]
    return "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in "+-.,/@_%()[]:#$=" else "other"


def features(text: str, a: int, b: int) -> list[str]:
    """Features of the segment ``text[a:b]`` as a whole."""
    part = text[a:b]
    left, right = _side(text, a - 1), _side(text, b)
    beyond = _side(text, b + 1) if right in ".,-/" else ""
    out = ["any", f"left {left}", f"right {right}", f"beyond {right}{beyond}"]
    if form := _ADDRESS_FORM.fullmatch(part):
        mark = form[2].strip()
        out += ["address", f"mark {mark[:1]}{'w' if mark == 'at' else ''}", f"spaced {form[2] != mark}", f"dotted {'.' in form[3]}"]
        if mark == "at":
            out.append(f"spelled {' dot ' in form[3]}")
        out.append(f"goes on {bool(_MORE.match(text, b))}")
        return out
    if any(c.isalpha() or c == "@" for c in part):
        return [*out, "no form"]
    groups = re.findall("[0-9]+", part)
    separators = re.findall("[^0-9]+", part.strip("+("))
    digits = "".join(groups)
    n = len(digits)
    lengths = [len(g) for g in groups]
    kinds = "".join(sorted(set("".join(separators).replace(" ", " ").replace("–", "-"))))
    shape = "-".join(map(str, lengths[:6]))
    fours = len(groups) > 1 and all(x == 4 for x in lengths[:-1]) and lengths[-1] <= 4
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    alike = len(set(separators)) <= 1
    first = part[0] if part[0] in "+(" else "digit"
    if part.count("(") != part.count(")"):
        out.append("unbalanced")
    check = f"check {13 <= n <= 19 and luhn(digits)}"  # other lengths have none
    dots = alike and len(separators) > 0 and separators[0].strip(" []()") == "."
    phone = lengths[-3:] == [3, 3, 4] and len(groups) <= 4 and (len(groups) == 3 or lengths[0] <= 3)
    out += [
        f"digits {n}", f"shape {shape}", f"groups {min(len(groups), 6)}", f"between {kinds}", f"alike {alike}", f"first {first}",
        f"fours {fours} {check}", f"one {len(groups) == 1} {check}", f"octets {octets} {dots}",
        f"phone {phone} {first} {left in ('space', '(', ':')}", f"plus {first == '+'} {9 <= n <= 15}",
        f"longest {max(map(len, separators), default=0)}", f"bracket {octets and part.count('[') + part.count('(') >= 3}",
    ]
    return out


def segments(text: str, a: int, b: int, taken: list[tuple[int, int]] = ()) -> tuple[list[int], list[tuple[int, int, tuple[int, ...]]]]:
    """Token boundaries of an island, and its segments (first boundary, last boundary, possible types) in order of their ends."""
    marks = [m.start() for m in _TOKEN.finditer(text, a, b)] + [b]
    blocked = np.zeros(b - a + 1, dtype=bool)
    for x, y in taken:
        blocked[max(x - a, 0) : max(y - a, 0)] = True
    found = []
    addresses = {(i, e) for i, e in _address_segments(text, a, b)}
    where = {at: k for k, at in enumerate(marks)}
    for x, y in addresses:
        if x in where and y in where and not blocked[x - a : y - a].any():
            found.append((where[x], where[y], (0,)))
    for i in range(len(marks) - 1):
        if not ("0" <= text[marks[i]] <= "9" or text[marks[i]] in "+("):
            continue
        n = groups = 0
        for j in range(i + 1, min(i + MAX_TOKENS, len(marks) - 1) + 1):
            token = text[marks[j - 1] : marks[j]]
            if blocked[marks[j - 1] - a] or token[0] not in _NUMERIC or (j > i + 1 and token[0] == "+") or marks[j] - marks[i] > MAX_CHARS:
                break
            if "0" <= token[0] <= "9":
                n, groups = n + len(token), groups + 1
                if n > 19 or groups > MAX_GROUPS:
                    break
                if n >= 4:
                    found.append((i, j, (1, 2, 3)))
    found.sort(key=lambda s: (s[1], s[0]))
    return marks, found


def _address_segments(text: str, a: int, b: int):
    """Addresses with a marker: from each token of the local part on, to each label of the domain."""
    for m in _ADDRESS.finditer(text, a, b):
        tail = _DOMAIN_TAIL.match(text, m.end(), b)
        local = _LOCAL.search(text, max(a, m.start() - 64), m.start())
        if not tail or not local[0]:
            continue
        starts = [t.start() for t in _TOKEN.finditer(text, local.start(), m.start())]
        ends = [t.end() for t in _TOKEN.finditer(text, m.end(), tail.end()) if t[0][0].isalnum()]
        for x in starts[:MAX_TOKENS]:
            for y in ends[:MAX_TOKENS]:
                if y - x <= MAX_CHARS:
                    yield x, y


# Decoding and training


def best_segments(n: int, found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Best disjoint scored segments (first, last, type, score) over boundaries 0..n, by dynamic programming."""
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    by_end: dict[int, list] = {}
    for s in found:
        by_end.setdefault(s[1], []).append(s)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for s in by_end.get(j, ()):
            if best[s[0]] + s[3] > best[j]:
                best[j], back[j] = best[s[0]] + s[3], s
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            out.append(back[j][:3])
            j = back[j][0]
    return out[::-1]


def added_spans(text: str, taken: list[tuple[str, int, int]], weights: Weights, margin: float = MIN_MARGIN) -> list[tuple[str, int, int]]:
    """Spans the model adds to those of the rules, by kind and start."""
    out, ranges, first = [], sorted((x, y) for _, x, y in taken), 0
    for a, b in islands(text):
        while first < len(ranges) and ranges[first][1] <= a:
            first += 1
        near = []
        for x, y in ranges[first:]:
            if x >= b:
                break
            near.append((x, y))
        marks, found = segments(text, a, b, near)
        scored = []
        for i, j, types in found:
            known = [weights[f] for f in features(text, marks[i], marks[j]) if f in weights]
            for t in types:
                score = sum([w[t] for w in known]) - margin
                if score > 0:
                    scored.append((i, j, t, score))
        out += [(KINDS[t], marks[i], marks[j]) for i, j, t in best_segments(len(marks) - 1, scored)]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def fit_weights(examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = _EPOCHS) -> Weights:
    """Weights that maximise the likelihood of labelled texts."""
    index: dict[tuple[int, str], int] = {}
    rows, columns, lattices, gold = [], [], [], []
    count = 0
    for text, spans in examples:
        labels = {(x, y): KINDS.index(k) for k, x, y in spans}
        for a, b in islands(text):
            marks, found = segments(text, a, b)
            lattice = []
            for i, j, types in found:
                known = features(text, marks[i], marks[j])
                for t in types:
                    lattice.append((i, j, count))
                    gold.append(labels.get((marks[i], marks[j])) == t)
                    for f in known:
                        rows.append(count)
                        columns.append(index.setdefault((t, f), len(index)))
                    count += 1
            if lattice:
                lattices.append((len(marks) - 1, lattice))
    rows, columns, gold = np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64), np.array(gold, dtype=float)
    w, squares = np.zeros(len(index)), np.full(len(index), 1e-8)
    for _ in range(epochs if count else 0):
        score = np.bincount(rows, w[columns], minlength=count)
        chance = np.zeros(count)
        for n, lattice in lattices:
            segment_chances(n, lattice, score, chance)
        slope = np.bincount(columns, (gold - chance)[rows], minlength=len(index)) / len(lattices) - _DECAY * w
        squares += slope**2
        w += _RATE * slope / np.sqrt(squares)
    weights: Weights = {}
    for (t, f), k in index.items():
        weights.setdefault(f, [0.0] * len(KINDS))[t] = float(w[k])
    return weights


def segment_chances(n: int, lattice: list[tuple[int, int, int]], score: np.ndarray, chance: np.ndarray) -> None:
    """Marginal probability of every segment (first, last, place in ``score``), by forward and backward sums."""
    ends: dict[int, list] = {}
    starts: dict[int, list] = {}
    for s in lattice:
        ends.setdefault(s[1], []).append(s)
        starts.setdefault(s[0], []).append(s)
    before, after = [0.0] * (n + 1), [0.0] * (n + 1)

    def total(values: list[float]) -> float:
        most = max(values)
        return most + math.log(sum(math.exp(v - most) for v in values))

    for j in range(1, n + 1):
        more = ends.get(j)
        before[j] = total([before[j - 1], *[before[i] + score[k] for i, _, k in more]]) if more else before[j - 1]
    for i in range(n - 1, -1, -1):
        more = starts.get(i)
        after[i] = total([after[i + 1], *[after[j] + score[k] for _, j, k in more]]) if more else after[i + 1]
    for i, j, k in lattice:
        chance[k] = math.exp(before[i] + score[k] + after[j] - before[n])


# Labelled examples


def respelled(kind: str, span: str, draw: random.Random) -> str:
    """Another spelling of the same entity."""
    if kind == "email":
        local, _, domain = span.partition("@")
        at = draw.choice([" [at] ", "[at]", "(at)", " (at) ", " @ ", " at ", " {at} "])
        dot = " dot " if at == " at " else draw.choice([".", "[dot]", " [dot] ", "(dot)", " (dot) ", " dot "])
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return span.replace(".", draw.choice(["[.]", "(.)", " . ", " [.] ", "[.]"]))
    digits = _digits(span)
    if kind == "card":
        by = draw.choice([".", "/", " ", "  ", "–", " - "])
        return by.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    area, head, tail = digits[-10:-7], digits[-7:-4], digits[-4:]
    if len(digits) < 10:
        return span
    country = digits[:-10]
    plain = draw.choice([f"({area}) {head}-{tail}", f"{area}-{head}-{tail}", f"{area}.{head}.{tail}", f"({area}) {head} {tail}", f"{area}/{head}-{tail}"])
    return draw.choice([plain, plain, f"{country or 1} {plain}", f"00{country or 1} {plain}", f"+{country or 1}/{area}/{head}/{tail}", f"+{country or 1} {area} {head} {tail}"])


def harmless(draw: random.Random) -> str:
    """A number or phrase that is no personal data."""
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    year = str(draw.randint(1900, 2040))
    month, day = f"{draw.randint(1, 12):02d}", f"{draw.randint(1, 28):02d}"
    failing = number(16)
    while luhn(failing):
        failing = number(16)
    by = draw.choice([" ", "-", ".", "/"])
    return draw.choice([
        f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{year}-{month}-{day} {day}:{month}:{number(2)}",
        f"{number(1)}.{number(draw.randint(4, 12))}", f"{draw.randint(1, 9)},{number(3)},{number(3)}", f"{draw.randint(1, 99)},{number(3)},{number(3)},{number(3)}",
        f"{draw.randint(1, 30)}.{number(1)}.{number(2)}", f"{draw.randint(1, 30)}.{number(1)}.{number(2)}.{draw.randint(300, 9999)}",
        f"{number(1)}.{number(1)}.{number(1)}.{number(1)}.{number(1)}.{number(1)}", failing, by.join(failing[k : k + 4] for k in range(0, 16, 4)),
        number(draw.randint(9, 14)), number(draw.randint(20, 30)), f"{number(3)}-{number(4)}", " ".join(number(2) for _ in range(draw.randint(3, 9))),
        f"{number(4)}-{number(4)}", f"({number(2)}, {number(2)}, {number(4)})", f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}",
        f"{year} {year}", f"{year}-{year}, {number(3)}-{number(3)}", f"x{number(10)}", f"{number(10)}abc", f"{number(3)} {number(5)} {number(2)}",
        ", ".join(number(3) for _ in range(5)), f"{number(4)} {number(4)} {number(4)}", f"${number(3)},{number(3)}.{number(2)}", f"{number(5)}-{number(4)}",
        "@ the", "look at the dot", "meet at noon", "at home. Then", "code@", "a @ b", f"at {number(2)} dot {number(3)}",
    ])


def _made(kind: str, draw: random.Random) -> str:
    """An entity in its usual spelling."""
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice("abcdefghiklmnoprstuvw") for _ in range(draw.randint(2, 8)))
    if kind == "email":
        return f"{word()}{draw.choice(['.', '_', ''])}{draw.choice([word(), number(2)])}@{word()}.{draw.choice(['com', 'org', 'example.net', 'co.uk'])}"
    if kind == "ip":
        return ".".join(str(draw.randint(0, 255)) for _ in range(4))
    if kind == "card":
        head = draw.choice("3456") + number(14)
        return next(head + c for c in "0123456789" if luhn(head + c))
    return f"+{draw.randint(1, 99)} ({draw.randint(200, 999)}) {draw.randint(200, 999)}-{number(4)}"


def training_examples(spans: list[tuple[str, str, str, str]], seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled texts from spans (kind, span, text before, text after): as they are, respelled, and with harmless numbers instead."""
    draw = random.Random(seed)
    sides = [("see ", " for"), ("", ""), ("call: ", ", or"), ("(", ")"), ("id ", "."), ("\n", "\n"), ("from ", ". Then")]
    spans = list(spans) + [(k, _made(k, draw), *draw.choice(sides)) for k in KINDS for _ in range(60)]
    out = []
    for kind, span, before, after in spans:
        for spelled in (span, respelled(kind, span, draw), respelled(kind, span, draw)):
            out.append((before + spelled + after, [(kind, len(before), len(before) + len(spelled))]))
        out.append((before + harmless(draw) + after, []))
    return out


def _sampled_spans(docs: DataFrame, sample_docs: int, sample_spans: int) -> list[tuple[str, str, str, str]]:
    """Spans of the rules in documents chosen by hash, with a few characters before and after them: at most ``sample_spans``, lowest hash first."""
    every = max(1, docs.count() // sample_docs)
    by = F.xxhash64("doc_id", "text")
    some = docs.where(F.pmod(by, F.lit(every)) == 0) if every > 1 else docs

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                for kind, a, b in base_spans(text or ""):
                    before, after = re.search(r"[^0-9@]{0,6}\Z", text[max(0, a - 6) : a])[0], re.match(r"[^0-9@]{0,6}", text[b : b + 6])[0]
                    if b - a <= MAX_CHARS:
                        out.append((kind, text[a:b], before, after))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(4)], names=["kind", "span", "before", "after"])

    found = some.select("doc_id", "text").mapInArrow(run, "kind string, span string, before string, after string")
    found = found.groupBy("kind", "span").agg(F.min("before").alias("before"), F.min("after").alias("after"))
    rows = found.orderBy(F.xxhash64("kind", "span"), "kind", "span").limit(sample_spans).collect()
    return [tuple(r) for r in rows]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS) -> Weights:
    """Weights from a bounded sample of documents (``doc_id``, ``text``) and made examples."""
    return fit_weights(training_examples(_sampled_spans(docs, sample_docs, sample_spans)))


# Over documents


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Weights | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``base`` and ``added``, the spans of the rules and those of the model, by kind and start."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    model = train(rows) if weights is None else weights
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            base, added = [], []
            for value in batch.column(1).to_pylist():
                rules = base_spans(value or "")
                base.append([dict(zip(("kind", "start", "end"), s)) for s in rules])
                more = added_spans(value or "", rules, model)
                added.append([dict(zip(("kind", "start", "end"), s)) for s in more])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(added, kind)], names=["doc_id", "base", "added"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {SPANS}, added {SPANS}")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named after the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Weights | None = None) -> DataFrame:
    """The rows with their personal data replaced by its kind; all else, null texts too, as it was."""
    model = train(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))) if weights is None else weights

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text)
            values = []
            for value in batch.column(place).to_pylist():
                rules = base_spans(value or "")
                values.append(value if value is None else mask(value, rules + added_spans(value, rules, model)))
            yield batch.set_column(place, batch.schema.field(place), pa.array(values, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
