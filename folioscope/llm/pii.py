"""Personal data: patterns for email, ip, card and phone, and a linear-chain conditional random field for the rest.

The field labels white-space-parted tokens of each line from word shapes of a token and its neighbours. It is trained on
a small labelled table, made from the templates below, and decoded by Viterbi over many lines at once. It adds spans
that the patterns do not have: telephone numbers in national form, secrets, identity numbers and bank accounts.
"""

from __future__ import annotations

import functools
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Numbers, in_arrow

KINDS = ("email", "ip", "card", "phone", "secret", "id", "iban")
BASE = 4
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
#: A match can only start where a run of digits does, and runs are taken whole, so long runs are read once.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Each match holds one @ and starts where the run of local characters before it does, or where the last match ended."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by kind and start; code points, end exclusive."""
    out = _emails(text)
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


#: Labelled lines: [kind] stands for a made-up value of that kind, [date] and the like for values that are no personal data.
TEMPLATES = (
    "Call me at [phone] after lunch.",
    "phone: [phone]",
    "Tel. [phone] or by mail",
    "Telefon [phone] bitte",
    "Mi teléfono es [phone] gracias.",
    "Mon numéro est le [phone] merci",
    "You can reach the office under [phone], every day.",
    "She wrote [phone] on the back of the card",
    "fax [phone]",
    "[phone] is the number of the front desk.",
    "SUPPORT LINE >>> [phone] <<<",
    'token = "[secret]"',
    'api_key = "[secret]" in the settings',
    "password: [secret]",
    "the key is [secret] and keep it",
    "Please set access_token = '[secret]' before the run",
    "secret=[secret]",
    "export API_TOKEN=[secret]",
    "Authorization: Bearer [secret]",
    "My social security number is [id] as of now.",
    "SSN: [id]",
    "taxpayer [id] filed late",
    "IBAN [iban] at the bank",
    "Transfer it to [iban] please.",
    "account: [iban]",
    "Konto [iban] bei der Sparkasse",
    "The meeting is on [date] at noon.",
    "Licensed under the Apache License, Version 2.0.",
    "under the GNU General Public License, version 3.",
    "It cost [price] in [year] and [price] later.",
    "Order [number] was sent on [date].",
    "In [year] there were [number] of them.",
    "Chapter [small] of [small], page [small]",
    "A quiet morning by the sea, with nothing to do.",
    "Nous avons mangé au restaurant hier soir",
    "Wir gehen heute nicht ins Kino, sondern bleiben zu Hause.",
    "Ayer fuimos al mercado con los niños",
    "WOW!!! BEST DEAL EVER!!! CLICK NOW!!!",
    "--- *** --- ### --- %%% --- &&& ---",
    "home | about | contact | imprint | log in",
    "a | b | c |",
    "Release [small].[small] came out on [date], see [number].",
    "call 911 or [small] in the end",
    "the ratio was [small] - [small] at half time",
    "ISBN [number] and id [number]",
    "order id: [number], phone model [small]",
    "The key of the house and the token of love",
    "mail to [email] today",
    "host [ip] is up",
    "card [card] expires",
    "call [intl] now",
    "commit message: fixed the build (see above)",
    "Internationalization and counterrevolutionaries are long words",
)
LABELS = ("O", "B-phone", "I-phone", "B-secret", "I-secret", "B-id", "I-id", "B-iban", "I-iban")
ROWS_PER_TEMPLATE, TRAIN_STEPS = 12, 150


def labelled_table(seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Rows of tokens and their labels: the templates filled with values drawn from the seed."""
    rng = random.Random(seed)
    some = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    d = lambda n: some("0123456789", n)
    big, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    iban = lambda: some(big, 2) + d(2) + rng.choice([d(18), some(big, 4) + d(14), d(20)])
    value = {
        "phone": lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(6)}", f"{d(3)} {d(3)} {d(4)}"]),
        "secret": lambda: rng.choice([some("0123456789abcdef", rng.choice([32, 40, 64])), some(low + big + "0123456789", rng.randrange(20, 44))]),
        "id": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "iban": lambda: (lambda x: rng.choice([x, " ".join(x[i : i + 4] for i in range(0, len(x), 4))]))(iban()),
        "date": lambda: rng.choice([f"20{d(2)}-0{rng.randrange(1, 9)}-1{d(1)}", f"1{d(1)}.0{rng.randrange(1, 9)}.20{d(2)}", f"1{d(1)}/0{rng.randrange(1, 9)}/{d(2)}"]),
        "price": lambda: f"${d(2)}.{d(2)}",
        "year": lambda: f"19{d(2)}",
        "number": lambda: d(rng.randrange(4, 13)),
        "small": lambda: d(rng.randrange(1, 3)),
        "email": lambda: f"a.b{d(2)}@mail{d(1)}.example.com",
        "ip": lambda: f"{d(2)}.{d(2)}.{d(2)}.{d(1)}",
        "card": lambda: d(16),
        "intl": lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}",
    }
    out = []
    for template in TEMPLATES:
        for _ in range(ROWS_PER_TEMPLATE):
            tokens, labels, inside = [], [], False
            for part in re.split(r"(\[\w+\])", template):
                kind = part[1:-1] if part.startswith("[") else ""
                code = LABELS.index(f"B-{kind}") if f"B-{kind}" in LABELS else 0
                for i, t in enumerate(re.split(r"\s+", value[kind]() if kind else part)):
                    if i == 0 and inside:  # goes on within a token
                        tokens[-1] += t
                        labels[-1] = labels[-1] or (code if t else 0)
                    else:
                        tokens.append(t)
                        labels.append(code and code + (i > 0))
                inside = True
            held = [(t, y) for t, y in zip(tokens, labels, strict=True) if t]
            out.append(([t for t, _ in held], [y for _, y in held]))
    return out




class _Signs(dict):
    """What stands for a character in a shape: U, l or 9, other letters l, ASCII signs themselves, the rest ?."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = sign = "l" if c.isalpha() else c if c.isascii() else "?"
        return sign


_SIGNS = _Signs({**dict.fromkeys(range(65, 91), "U"), **dict.fromkeys(range(97, 123), "l"), **dict.fromkeys(range(48, 58), "9")})
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_EDGE = re.compile(r"^[\W_]*|[\W_]*$")
_CUES = frozenset("tel telefon phone fax call teléfono numéro número token key api_key apikey secret password passwort clave bearer version order isbn id ssn iban account konto number security".split())


def shape_features(token: str) -> tuple[str, ...]:
    """Collapsed shape, exact shape where there are digits, size, share of digits, what opens the token, and cue words."""
    t = _EDGE.sub("", token)
    s = t.translate(_SIGNS)
    digits = s.count("9")
    mixed = digits > 1 and (s.count("l") + s.count("U")) > 1
    out = [f"s {_RUN.sub(chr(92) + '1', s)}", f"n {len(s).bit_length()} {4 * digits // max(1, len(s))}", f"m {mixed and len(s) >= 20 and s.isalnum()}"]
    if digits:
        out.append(f"x {s}")
        if token[0] in "(+$":
            out.append(f"o {token[0]}")
    if (low := t.lower()) in _CUES:
        out.append(f"w {low}")
    if token in ("=", ":"):
        out.append(f"w {token}")
    return tuple(out)


@dataclass
class Field:
    """Numbers of the features met in training; their weights for a token, the one after and the one before it (3 x features x labels); steps between labels."""

    names: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray

    def slots(self, token: str) -> tuple[int, ...]:
        """The known features of a token; those that training never met weigh nothing."""
        return tuple(self.names[f] for f in shape_features(token) if f in self.names)


def train(rows: list[tuple[list[str], list[int]]], iterations: int = TRAIN_STEPS, l2: float = 0.02) -> Field:
    """Maximum likelihood by gradient steps with momentum over all rows, by forward and backward sums."""
    k, n = len(LABELS), len(rows)
    size = np.array([len(t) for t, _ in rows])
    width = int(size.max())
    names = Numbers()
    slots = [[[names[f] for f in shape_features(t)] for t in tokens] for tokens, _ in rows]
    at = [(o, i, t, s) for i, row in enumerate(slots) for t in range(len(row)) for o, u in ((0, t), (1, t - 1), (2, t + 1)) if 0 <= u < len(row) for s in row[u]]
    o, i, t, s = (np.array(x) for x in zip(*at, strict=True))
    gold = np.zeros((n, width), int)
    for r, (_, y) in enumerate(rows):
        gold[r, : len(y)] = y
    real = np.arange(width) < size[:, None]
    w, a = np.zeros((3, len(names), k)), np.zeros((k, k))
    vw, va = np.zeros_like(w), np.zeros_like(a)
    one = np.eye(k)[gold] * real[:, :, None]
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for it in range(iterations):
        e = np.zeros((n, width, k))
        np.add.at(e, (i, t), w[o, s])
        f, b = np.zeros((n, width, k)), np.zeros((n, width, k))
        f[:, 0] = e[:, 0]
        for c in range(1, width):
            f[:, c] = np.where(real[:, c, None], lse(f[:, c - 1, :, None] + a, 1) + e[:, c], f[:, c - 1])
        for c in range(width - 2, -1, -1):
            b[:, c] = np.where(real[:, c + 1, None], lse(a + (e[:, c + 1] + b[:, c + 1])[:, None, :], 2), 0)
        z = lse(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None]) * real[:, :, None]
        pair = np.exp(np.minimum(f[:, :-1, :, None] + a + (e + b)[:, 1:, None, :] - z[:, None, None, None], 0)) * real[:, 1:, None, None]
        gw, ga = np.zeros_like(w), (one[:, :-1, :, None] * one[:, 1:, None, :]).sum((0, 1)) - pair.sum((0, 1))
        np.add.at(gw, (o, s), (one - p)[i, t])
        vw, va = 0.9 * vw + gw - l2 * w, 0.9 * va + ga - l2 * a
        w, a = w + 0.02 * vw * (0.3 + 0.7 * min(1, it / 20)), a + 0.02 * va
    return Field(dict(names), w, a)


@functools.cache
def trained() -> Field:
    """The field that the table of the templates gives."""
    return train(labelled_table())


class Decoder:
    """Viterbi over many lines at once; tokens of equal features share a row of emission weights.

    A stretch of labels other than O can only win if its gains over O, with the best steps there are, add up to more
    than nothing. Tokens in no such stretch are O for certain, so only the others are decoded, with O around them.
    """

    def __init__(self, field: Field):
        self.field = field
        self.types: dict[tuple[int, ...], int] = {}
        self.rows = np.zeros((3, 64, len(LABELS)))
        self.type_of = Memo(self._type)
        self.step = 2 * max(0.0, float((field.steps - field.steps[0, 0]).max()))

    def _type(self, token: str) -> int:
        slots = self.field.slots(token)
        if (n := self.types.get(slots)) is None:
            n = self.types[slots] = len(self.types)
            if n == self.rows.shape[1]:
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], 1)
            self.rows[:, n] = self.field.weights[:, list(slots)].sum(1)
        return n

    def labels(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The labels of all tokens in order, and where each line starts among them. No line is empty."""
        start = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
        total = int(start[-1])
        of = np.fromiter((n for x in lines for n in map(self.type_of.__getitem__, x)), np.int64, total)
        e = self.rows[0, of]
        first, last = np.zeros(total, bool), np.zeros(total, bool)
        first[start[:-1]], last[start[1:] - 1] = True, True
        inner = np.flatnonzero(~first)
        e[inner] += self.rows[1, of[inner - 1]]
        e[inner - 1] += self.rows[2, of[inner]]
        gain = e[:, 1:].max(1) - e[:, 0] + self.step
        # The largest sum of gains of a stretch of the line that ends, or starts, at each token.
        line = np.cumsum(first) - 1
        left = _runs(gain, line)
        right = _runs(gain[::-1], line[::-1])[::-1]
        maybe = left + right - gain > -1e-6
        out = np.zeros(total, np.int8)
        head = np.flatnonzero(maybe & (first | ~np.concatenate([[False], maybe[:-1]])))
        tail = np.flatnonzero(maybe & (last | ~np.concatenate([maybe[1:], [False]])))
        if len(head):
            self._decode(e, head, tail - head + 1, first, last, out)
        return out, start

    def _decode(self, e: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray, out: np.ndarray) -> None:
        """The best labels of the stretches, with O before and after them within their line, written to out."""
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        steps = self.field.steps
        back = np.zeros((int(size.sum()), e.shape[1]), np.int8)
        place = np.cumsum(size) - size
        active = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # stretches longer than t
        score = e[begin] + np.where(first[begin], 0.0, 1.0)[:, None] * steps[0]
        for t in range(1, int(size[0])):
            m = active[t]
            via = score[:m, :, None] + steps
            best = via.argmax(1)
            back[place[:m] + t] = best
            score[:m] = np.take_along_axis(via, best[:, None, :], 1)[:, 0] + e[begin[:m] + t]
        end = begin + size - 1
        now = (score + np.where(last[end], 0.0, 1.0)[:, None] * steps[:, 0]).argmax(1)
        out[end] = now
        for t in range(int(size[0]) - 1, 0, -1):
            m = active[t]
            # Stretches that are longer than t go back from their label at t to that at t - 1.
            now[:m] = back[place[:m] + t, out[begin[:m] + t]]
            out[begin[:m] + t - 1] = now[:m]

    def spans(self, texts: list[str], tokens_at_once: int = 200_000) -> list[list[Span]]:
        """Spans that the field finds in each text, line by line."""
        out: list[list[Span]] = [[] for _ in texts]
        held: list[tuple[int, int, str]] = []
        lines: list[list[str]] = []
        n = 0

        def flush():
            nonlocal held, lines, n
            if lines:
                labels, start = self.labels(lines)
                for row in np.unique(np.searchsorted(start, np.flatnonzero(labels), "right") - 1).tolist():
                    d, offset, line = held[row]
                    out[d] += _spans(line, labels[start[row] : start[row + 1]].tolist(), offset)
            held, lines, n = [], [], 0

        for d, text in enumerate(texts):
            offset = 0
            for line in text.split("\n"):
                if tokens := line.split():
                    held.append((d, offset, line))
                    lines.append(tokens)
                    n += len(tokens)
                    if n >= tokens_at_once:
                        flush()
                offset += len(line) + 1
        flush()
        return out


def _runs(gain: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The largest sum of a run of gains that ends at each place, within its line (numbers that differ between lines)."""
    new = np.concatenate([[True], line[1:] != line[:-1]])
    far = 1.0 + 2 * np.abs(gain).sum()
    # Between lines the sum falls by more than any run can gain, so no run that starts before is the best.
    total = np.cumsum(gain - np.where(new, far, 0.0)) + 0.0
    before = total - gain
    return total - np.minimum.accumulate(before)


_TOKEN = re.compile(r"\S+")
_NAMED = re.compile(r".*[=:](?=.{16})")


def _spans(line: str, labels: list[int], offset: int) -> list[Span]:
    out: list[list] = []
    for i, (m, y) in enumerate(zip(_TOKEN.finditer(line), labels, strict=True)):
        if not y:
            continue
        kind = LABELS[y][2:]
        if LABELS[y][0] == "I" and out and out[-1][0] == kind and out[-1][3] == i - 1:
            out[-1][2:] = m.end(), i
        else:
            out.append([kind, m.start(), m.end(), i])
    found = []
    for kind, a, b, _ in out:
        if kind == "secret" and (m := _NAMED.search(line, a, b)):  # name=value as one token
            a = m.end()
        while a < b and not (line[a].isalnum() or (kind == "phone" and line[a] in "(+")):
            a += 1
        while a < b and not (line[b - 1].isalnum() or (kind == "secret" and line[b - 1] in "=/+")):
            b -= 1
        digits = sum(c in "0123456789" for c in line[a:b])
        least = {"phone": 7 <= digits <= 15, "secret": b - a >= 16, "id": digits == 9, "iban": b - a >= 15}
        if least[kind]:
            found.append((kind, offset + a, offset + b))
    return found


def merged(base: list[Span], added: list[Span]) -> list[Span]:
    """All base spans and the added ones that overlap none of them, by kind and start."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
    keep = []
    for s in added:
        i = int(np.searchsorted(starts, s[2], "left"))  # base spans that start before it ends
        if i == 0 or reach[i - 1] <= s[1]:
            keep.append(s)
    return sorted(base + keep, key=lambda s: (KINDS.index(s[0]), s[1]))


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _found(texts: list[str], decoder: Decoder) -> list[tuple[list[Span], list[Span]]]:
    base = [base_spans(t) for t in texts]
    return [(b, merged(b, a)) for b, a in zip(base, decoder.spans(texts), strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_PART = 128


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base array<struct<kind,start,end>>, spans (base and added ones) of every row.

    Offsets are code points, end exclusive. Null and empty texts have no spans. Repeated rows and null ids stay. No
    documents: no rows. Extra columns are ignored. Training takes the templates above only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    kind = docs.schema[id_col].dataType.simpleString()
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    rows_of = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches):
        decoder = Decoder(sent.value)
        for batch in batches:
            for part in (batch.slice(i, _PART) for i in range(0, batch.num_rows, _PART)):
                found = _found(part.column(1).to_pylist(), decoder)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([rows_of(f[i]) for f in found], pa.list_(one)) for i in (0, 1))], names=["id", "base", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    s = "array<struct<kind:string,start:bigint,end:bigint>>"
    return in_arrow(rows, run, f"id {kind}, base {s}, spans {s}").withColumnRenamed("id", id_col)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are but the text, in which each span is replaced by its kind; nulls stay."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    place, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        decoder = Decoder(sent.value)
        for batch in batches:
            for part in (batch.slice(i, _PART) for i in range(0, batch.num_rows, _PART)):
                texts = part.column(place).to_pylist()
                found = _found([t or "" for t in texts], decoder)
                new = pa.array([None if t is None else masked(t, f[1]) for t, f in zip(texts, found, strict=True)], part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(part.columns)], schema=part.schema)

    return in_arrow(docs, run, schema)
