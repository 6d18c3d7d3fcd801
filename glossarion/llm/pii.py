"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The field labels words O or B-/I- of a kind from features of their shape and their neighbours' shapes.
It is trained on the small labelled table below and decoded by Viterbi, in numpy, over many windows at
a time. Words more than REACH words away from any word with a digit, an @ or a bracketed "at" are O by
the model's structure; windows hold the others. A decoded span counts if it has the form of its kind
and overlaps no span of the fixed patterns.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WORD, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = 2
MARK = re.compile(r"[0-9@]|\(at\)|\[at\]", re.I)

#: The labelled table: sentences in which [kind text] is a span.
LABELLED = """
call [phone (415) 555-0132] before noon
her number is [phone 415-555-0198] and his is [phone 212-555-0143]
phone: [phone 646.555.0177] or write to the office
reach us at [phone (212) 555-0110] ext 12
the desk at [phone 303-555-0161] is open from 9 to 5
tel [phone 0171 555 0199] in the evening
fax [phone (030) 555 0142] for orders
ring [phone 555-0123] now
dial [phone (206) 555-0114] for help
mobile [phone 07700 900123] is off
write to [email jane(at)example.com] today
mail [email john.doe[at]example.org] for the list
her address [email anna.k(at)mail.example.net] is new
send it to [email sales[at]shop.example.com] please
ask [email bob@localhost] or [email root@server] about it
contact [email info@example.com] or [phone (415) 555-0170]
the card [card 3782 822463 10005] was stolen
card no [card 378282246310005] expires 09/27
charged to [card 3714 496353 98431] yesterday
account [card 30569309025904] is closed
paid by [card 6011-0009-9013-942] in May
host [ip 2001:db8::1] is down
ping [ip fe80::1] from the lab
route to [ip 2001:db8:85a3::8a2e:370:7334] failed
server [ip 2001:0db8:0000:0000:0000:ff00:0042:8329] answers
from [ip 10.0.0.1] and [ip 192.168.0.12] came requests
forward it to [email k.lindqvist+lists@post.example.org] as well
overseas callers dial [phone +44 20 7946 0018] first
card [card 4111111111111111] was used
the schema moved from release 2.0 to 2.1.
clause 4.0 of the contract applies
see appendix C, revision 3.
on 12 May 1999 the price was 3,450.00 dollars
from 1999 to 2004 there were 12 cases
it took 3.5 hours on 2024-01-31 at 12:30:45
order 4711-0815 came with 20 items
chapter 12.3.1 of the 2nd edition (1998)
isbn 978-3-16-148410-0 is out of print
the ratio was 0.123456 in 1,000,000 trials
its checksum 9e107d9d372bb6826bd81d3542a419d6 did not match
commit 1f0c2ab4 and ticket #2217 belong together
see page 123-125 and note 7
room 101 on floor 3 of 10
score 3-2 after 90 minutes
version v1.2.3-beta of build 20240131
@home and @work are tags
invoice 100234567 of 31/01/2024
zip 90210-1234 and po box 555
our hotline [phone 212 555 0188] never closes
text me on [phone 555.0167] later
home: [phone (0161) 496 0123], work: [phone 0161 496 0456]
leave word at [phone 310-555-0122].
write [email the.editor(at)paper.example.com], not to us
[email help[at]desk.example.org] answers within 3 days
amex [card 371449635398431] was declined
visa [card 4222222222222] is too old
diners [card 3852 000002 3237] was accepted
gateway [ip 2001:db8:0:1::ff] routes to [ip 2001:db8::2:1]
neighbour [ip fe80::a00:27ff:fe4e:66a1] is stale
between 10:15 and 11:45 on 3 June
lot 0042-17 weighs 18.5 kg
see rows 100 to 250 of table 7
the mac is 08:00:27:4e:66:a1
grid 52.5200, 13.4050 on the map
a 50% cut of 1/3 and 2/3
flight LH1234 at 10:05 from gate B12
the year 2024 and the year 2025
10 20 30 40 50
numbers 1234 5678 are examples
id 550e8400-e29b-41d4-a716-446655440000 is unique
""".strip().splitlines()


def labelled() -> list[tuple[list[str], list[int]]]:
    """The labelled table's words and label numbers."""
    rows = []
    for line in LABELLED:
        words, labels, at = [], [], 0
        for m in re.finditer(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[at\])+)\]", line):
            words += (before := line[at : m.start()].split())
            labels += [0] * len(before)
            words += (inside := m[2].split())
            labels += [LABELS.index(f"{'I' if i else 'B'}-{m[1]}") for i in range(len(inside))]
            at = m.end()
        words += (rest := line[at:].split())
        rows.append((words, labels + [0] * len(rest)))
    return rows


def shape_features(word: str) -> tuple[str, ...]:
    """Features of a word's shape; the word's letters themselves don't enter."""
    core = word.rstrip(".,;:!?\"'").lstrip("\"'")
    head = core[:64]
    shape = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", re.sub(r"[0-9]", "9", head))
    short = re.sub(r"(.)\1+", r"\1", shape)
    digits = sum("0" <= c <= "9" for c in head)
    has = "".join(c for c in "@.-:()[]+/=%" if c in head)
    return (
        f"shape={shape if digits <= 19 and len(head) <= 24 else short}",
        f"short={short}",
        f"digits={min(digits, 17)}",
        f"has={has}|{'9' if digits else ''}{'x' if 'x' in short or 'X' in short else ''}",
        f"at={'(at)' in head.lower() or '[at]' in head.lower()}|{'@' in head}",
        f"hex={bool(re.fullmatch(r'[0-9A-Fa-f:]+', head)) and head.count(':') >= 2}",
    )


ROLES = ("word", "before", "after")


class Field:
    """Weights of features (feature, role) for each label, of label pairs, and of first labels."""

    def __init__(self, index: dict[tuple[str, str], int], emit: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.index, self.emit, self.move, self.first = index, emit, move, first
        self.cache: dict[str, np.ndarray] = {}

    def word_scores(self, word: str) -> np.ndarray:
        """A word's part in the label scores of itself, the next and the previous word (roles x labels)."""
        hit = self.cache.get(word)
        if hit is None:
            hit = np.zeros((3, len(LABELS)))
            for f in shape_features(word):
                for r, role in enumerate(ROLES):
                    i = self.index.get((f, role))
                    if i is not None:
                        hit[r] += self.emit[i]
            if len(self.cache) > 100_000:
                self.cache.clear()
            if len(word) <= 64:
                self.cache[word] = hit
        return hit

    def scores(self, windows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Label scores (windows x longest x labels), 0 beyond a window's end, and the windows' lengths."""
        n = np.array([len(w) for w in windows])
        out = np.zeros((len(windows), n.max(), len(LABELS)))
        for i, words in enumerate(windows):
            parts = np.stack([self.word_scores(w) for w in words])
            row = out[i, : len(words)]
            row += parts[:, 0]
            row[1:] += parts[:-1, 1]
            row[:-1] += parts[1:, 2]
        return out, n

    def decode(self, windows: list[list[str]]) -> list[np.ndarray]:
        """The likeliest labels of each window, by Viterbi over all windows at once."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(windows)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        for a in range(0, len(order), 2048):  # windows of like length together
            group = order[a : a + 2048]
            emit, n = self.scores([windows[i] for i in group])
            best, back = emit[:, 0] + self.first, np.zeros(emit.shape, np.int8)
            ends = best.copy()
            for t in range(1, emit.shape[1]):
                paths = best[:, :, None] + self.move
                back[:, t] = paths.argmax(1)
                best = paths.max(1) + emit[:, t]
                ends[n == t + 1] = best[n == t + 1]
            label = ends.argmax(1)
            path = np.zeros(emit.shape[:2], int)
            rows = np.arange(len(group))
            for t in range(emit.shape[1] - 1, -1, -1):
                path[rows[t < n], t] = label[t < n]
                label = np.where(t < n, back[rows, t, label], label)
            for i, p, k in zip(group, path, n, strict=True):
                out[i] = p[:k]
        return out


def train_field(rows: list[tuple[list[str], list[int]]], l2: float = 0.02, rounds: int = 150, rate: float = 0.3) -> Field:
    """Maximum likelihood with an L2 term by forward-backward and Adagrad, over all sentences at once."""
    keys = sorted({(f, r) for words, _ in rows for w in words for f in shape_features(w) for r in ROLES})
    index, k = {key: i for i, key in enumerate(keys)}, len(LABELS)
    n = np.array([len(w) for w, _ in rows])
    longest, b = n.max(), len(rows)
    where, what = [], []
    gold = np.zeros((b, longest), int)
    for i, (words, labels) in enumerate(rows):
        gold[i, : n[i]] = labels
        feats = [shape_features(w) for w in words]
        for t in range(n[i]):
            for role, j in (("word", t), ("before", t - 1), ("after", t + 1)):
                if 0 <= j < n[i]:
                    for f in feats[j]:
                        where.append(i * longest + t)
                        what.append(index[(f, role)])
    where, what = np.array(where), np.array(what)
    inside = np.arange(longest) < n[:, None]
    truth = np.eye(k)[gold] * inside[..., None]
    pair_truth = np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:])
    # an I- follows the B- or I- of its kind only
    banned = np.array([[b_.startswith("I-") and a[2:] != b_[2:] for b_ in LABELS] for a in LABELS])
    ban_first = np.array([x.startswith("I-") for x in LABELS])
    emit, move, first = np.zeros((len(keys), k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(x, 1e-6) for x in (emit, move, first)]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        u = np.zeros((b * longest, k))
        np.add.at(u, where, emit[what])
        u = u.reshape(b, longest, k)
        m, f0 = np.where(banned, -1e4, move), np.where(ban_first, -1e4, first)
        alpha, beta = np.zeros(u.shape), np.zeros(u.shape)
        alpha[:, 0] = f0 + u[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(inside[:, t, None], lse(alpha[:, t - 1, :, None] + m, 1) + u[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(inside[:, t + 1, None], lse(m[None] + (u[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + m + (u + beta)[:, 1:, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
        g_emit = np.zeros_like(emit)
        np.add.at(g_emit, what, (truth - p).reshape(-1, k)[where])
        grads = (g_emit - l2 * emit, pair_truth - pair.sum((0, 1)) - l2 * move, (truth - p)[:, 0].sum(0) - l2 * first)
        for x, g, s in zip((emit, move, first), grads, sums, strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    return Field(index, emit, np.where(banned, -1e4, move), np.where(ban_first, -1e4, first))


@lru_cache(maxsize=1)
def field() -> Field:
    return train_field(labelled())


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns' matches, in time linear in the text."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:  # an address holds one @: the longest name before it, then a domain
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((0, start, last))
        at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):  # four numbers at a time
        parts, pos = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in four):
                out.append((1, pos, pos + size))
            pos += size + 1
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def has_form(kind: int, span: str) -> bool:
    """Whether a decoded span can be of its kind."""
    digits = _NO_DIGIT.sub("", span)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]{1,64}(?:\(at\)|\[at\]|@)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*", span, re.I))
    if kind == 1:
        try:
            return ":" in span and len(span) <= 45 and ipaddress.ip_address(span).version == 6
        except ValueError:
            return False
    if kind == 2:
        return 13 <= len(digits) <= 19 and bool(re.fullmatch(r"[0-9 -]+", span)) and luhn(digits)
    return 7 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?[0-9 ().-]+", span))


def find_spans(texts: list[str], model: Field) -> list[list[tuple[int, int, int, bool]]]:
    """Of each text its spans (kind number, start, end, fixed), by kind, then start; ends are exclusive, in code points."""
    fixed = [fixed_spans(t) if MARK.search(t) else [] for t in texts]
    windows, home = [], []
    for i, text in enumerate(texts):
        marks = [m.start() for m in MARK.finditer(text)]
        if not marks:
            continue
        words = [m.span() for m in WORD.finditer(text)]
        near = np.unique(np.searchsorted([a for a, _ in words], marks, side="right") - 1)
        keep = np.unique(np.clip((near[:, None] + np.arange(-REACH, REACH + 1)).ravel(), 0, len(words) - 1))
        for run in np.split(keep, np.flatnonzero(np.diff(keep) > 1) + 1):
            spans = [words[j] for j in run]
            windows.append([text[a:b] for a, b in spans])
            home.append((i, spans))
    more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, spans), path in zip(home, model.decode(windows) if windows else [], strict=True):
        t = 0
        while t < len(path):
            if path[t] == 0:
                t += 1
                continue
            kind, start = (path[t] - 1) // 2, t
            t += 1
            while t < len(path) and path[t] == 2 + 2 * kind:
                t += 1
            a, b = spans[start][0], spans[t - 1][1]
            while b > a and texts[i][b - 1] in ".,;:!?\"'":
                b -= 1
            while a < b and texts[i][a] in "\"'":
                a += 1
            if has_form(kind, texts[i][a:b]):
                more[i].append((int(kind), a, b))
    out = []
    for base, added in zip(fixed, more, strict=True):
        taken = sorted((a, b) for _, a, b in base)
        free = [x for x in added if not any(a < x[2] and x[1] < b for a, b in taken)] if added else []
        out.append(sorted([(*x, True) for x in base] + [(*x, False) for x in free]))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,fixed:boolean>>"


def detect(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and spans (see SPANS), by kind in the order of KINDS, then by start, of each whole text.

    fixed tells the fixed patterns' spans from the field's. A null text counts as empty and has none.
    Rows stay where they are, repeated ones included; other columns are dropped; no rows give none.
    """
    model = field()
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"spans {SPANS}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("fixed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = find_spans([t or "" for t in batch.column("_text").to_pylist()], model)
            rows = [[(KINDS[k], a, b, f) for k, a, b, f in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=[*keep, "spans"])

    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each span in its text replaced by <KIND>; overlapping spans become one, named after the first.

    All other columns and rows stay; a null text stays null.
    """
    model, at = field(), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(at).to_pylist()
            new = []
            for t, spans in zip(texts, find_spans([t or "" for t in texts], model), strict=True):
                parts, end = [], 0
                for a, b, k in sorted((a, b, k) for k, a, b, _ in spans):
                    if a >= end:
                        parts += [t[end:a], f"<{KINDS[k].upper()}>"]
                    end = max(end, b)
                new.append(t if not parts else "".join(parts) + t[end:])
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
