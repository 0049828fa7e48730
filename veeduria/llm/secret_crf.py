"""Secret scan by a linear-chain conditional random field.

Fixed patterns find the plain cases (``base_spans``). A conditional random
field over tokens finds more: each token is tagged as outside, begin or
inside of a secret from its shape, the words before and after it, and
features of the whole file. The field is trained here: windows of tokens
around the secrets that the patterns found, and around other tokens with
digits, from a bounded sample of documents (``SAMPLE``), taken by the hash of
the text, so that the sample doesn't depend on how the rows lie. So that the
field learns more than the patterns, each window of a secret also counts with
the words around it unknown, and with the letters of the secret redrawn.

Decoding is Viterbi's, over whole documents. Most tokens can't be part of a
secret whatever their neighbours: where a token's score as outside exceeds
its others by more than any two transitions can make up, it is outside in the
best path, and the stretches between such tokens are decoded on their own;
the result is that of one pass over all.

Tokens with equal shape and word share a row of scores, computed once a task.

A span is ``kind:start:end`` in code points, end exclusive: the whole match
of a pattern, or the tokens of a tagged secret (``crf``) where no pattern's
span overlaps. Patterns work on UTF-8 bytes; all they match is ASCII, so
matches are those of the code points.

Defined results: a null text counts as empty and has no span; repeated rows
each give a row; without any secret found by the patterns nothing can be
learned, and the patterns' spans are all; an empty table gives an empty
result. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veeduria.llm.common import tidy
from veeduria.session import drop_written, reuse

SAMPLE = 200                 # documents with, and documents without secrets that are learned from
WINDOWS = 4                  # windows of each
REACH = 10                   # tokens on both sides of a window's middle
PASSES = 120
RATE, DECAY = 0.15, 1e-4
KEEP_TOKENS = 400_000        # remembered tokens of a task

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
CUES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LONG_HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

_SPACE = rb"\x20\x09-\x0D"
TOKEN = re.compile(rb"[%s]?(?:[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff%s])" % (_SPACE, _SPACE))
OUT, BEGIN, INSIDE = range(3)
BEFORE = 3                   # words before a token that count as its features


def base_spans(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, secret's start) in bytes, of all patterns."""
    found = []
    low = text.lower()
    if any(c in low for c in CUES):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 or more of these is the whole match of the pattern
    found += [(m.start(), 2, m.end(), m.start()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def _bucket(n: int) -> int:
    return n if n < 4 else min(n.bit_length() * 2 + (n >> (n.bit_length() - 2) & 1), 15)


_CLASSES = bytes(b"0"[0] if 48 <= c < 58 else b"A"[0] if 65 <= c < 91 else b"a"[0] if 97 <= c < 123 else
                 b"u"[0] if c > 127 else b" "[0] if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
_FLAT = re.compile(rb"(.)\1+", re.S)


def shape(token: bytes) -> tuple[str, ...]:
    """Features of a token's form."""
    core = token.lstrip(b" \t\n\x0b\x0c\r")
    spaced = "s" if len(core) < len(token) else "j"
    classes = core.translate(_CLASSES)
    if not core[:1].isalnum() and core[:1] < b"\x80":
        return (f"sign={core.decode()}", f"sign={core.decode()}{spaced}")
    n, digits = len(core), classes.count(b"0")
    kind = "".join(sorted(set(classes.decode())))
    out = [f"kind={kind}", f"kind={kind}{spaced}", f"len={_bucket(n)}", f"kindlen={kind}{_bucket(n)}"]
    if digits:
        changes = len(_FLAT.sub(rb"\1", classes)) - 1
        out += [f"digits={4 * digits // n}", f"changes={_bucket(changes)}", f"mixed={kind}{4 * changes // n}"]
        if n >= 8 and kind != "0" and re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", core):
            out.append("hexadecimal")
    return tuple(out)


def word(token: bytes) -> bytes:
    return token.lstrip(b" \t\n\x0b\x0c\r").lower()


def file_kind(has_digit: int, signs: int, n: int) -> int:
    """Features of a whole file, as one number: how many tokens have digits,
    how many are signs of assignments and blocks."""
    return (has_digit * 50 >= n) + (has_digit * 10 >= n) + 3 * (signs * 50 >= n)


FILE_KINDS = 6
_SIGNS = {b"=", b":", b"{", b"}", b";", b"<", b">"}


def _file_kind(tokens: list[bytes]) -> int:
    # of a document's tokens; the counts are kept per token in ``Scores``
    return file_kind(sum(not t.translate(None, b"0123456789") == t for t in tokens),
                     sum(t.strip() in _SIGNS for t in tokens), max(1, len(tokens)))


# ----------------------------------------------------------------- training --
def windows(text: bytes) -> list[tuple[list[bytes], list[int], int]]:
    """Up to ``WINDOWS`` windows of (tokens, tags, file kind): around the
    secrets of the patterns, else around tokens with digits, else the start."""
    found = list(TOKEN.finditer(text))
    tokens = [m.group() for m in found]
    tags, wide = [OUT] * len(tokens), [m.end() - len(m.group().lstrip()) for m in found]
    middles, k = [], 0
    for _, _, end, start in sorted(base_spans(text), key=lambda s: s[3]):
        while k < len(found) and wide[k] < start:
            k += 1
        i = k
        while i < len(found) and wide[i] < end:
            if tags[i] == OUT:
                tags[i] = BEGIN if i == k else INSIDE
            i += 1
        middles.append(k)
    if not middles:
        middles = [i for i, t in enumerate(tokens) if re.search(rb"\d", t)]
        middles = middles[::max(1, len(middles) // WINDOWS)] or [0]
    kind = _file_kind(tokens)
    cut = [(max(0, m - REACH), m + REACH) for m in middles[:WINDOWS]]
    return [(tokens[a:b], tags[a:b], kind) for a, b in cut if tokens[a:b]]


def sample(docs: DataFrame) -> list[tuple[list[bytes], list[int], int]]:
    """Windows of the ``SAMPLE`` texts of smallest hash with secrets of the
    patterns, and of as many without; equal texts count once."""
    def pick(batches):
        kept: tuple[dict, dict] = ({}, {})
        limits: list = [None, None]
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if not t:
                    continue
                h, c = hashlib.blake2b(t, digest_size=8).digest(), int(bool(base_spans(t)))
                if (limits[c] is None or h < limits[c]) and h not in kept[c]:
                    kept[c][h] = windows(t)
                    if len(kept[c]) > SAMPLE:
                        del kept[c][max(kept[c])]
                        limits[c] = max(kept[c])
        out = [(c, h, *w) for c in (0, 1) for h, ws in kept[c].items() for w in ws]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.list_(pa.binary()),
                                                            pa.list_(pa.int32()), pa.int32()))],
                names=["c", "h", "tokens", "tags", "file"])

    picked = reuse(docs.select("text").mapInArrow(
        tidy(pick), "c int, h binary, tokens array<binary>, tags array<int>, file int"))
    out = []
    for c in (0, 1):
        of = picked.where(F.col("c") == c)
        texts = [bytes(r.h) for r in of.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
        rows = of.where(F.col("h") <= F.lit(max(texts, default=b""))).distinct().collect()
        rows = sorted((bytes(r.h), [bytes(t) for t in r.tokens], list(r.tags), r.file) for r in rows)
        out += [r[1:] for r in rows]
    drop_written(picked)
    return out


def redrawn(tokens: list[bytes], tags: list[int], rng: random.Random) -> list[bytes]:
    """The window with another secret of the same length: of capital
    hexadecimal digits, or of letters and digits."""
    letters = rng.choice((b"0123456789ABCDEF", b"abcdefghijklmnopqrstuvwxyz0123456789",
                          b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    out = []
    for t, tag in zip(tokens, tags):
        if tag != OUT:
            core = t.lstrip()
            t = t[:len(t) - len(core)] + bytes(rng.choice(letters) if chr(c).isalnum() else c for c in core)
        out.append(t)
    return out


class Field:
    """Weights of a linear-chain conditional random field with three tags;
    ``known`` are the words that count by name as neighbours."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray, ends: np.ndarray, known: set[bytes]):
        self.weights, self.moves, self.ends, self.known = weights, moves, ends, known
        # what being outside can cost a token at most in the moves at it, compared
        # with its best tag: between two tokens, as the first, the last, the only one
        around = [moves[a][:, None] + moves for a in range(3)] + [ends[:, None] + moves, moves.T, ends[:, None]]
        self.margin = float(max((m.max(0) - m[OUT]).max() for m in around)) + 1e-6


def features(tokens: list[bytes], file: int, known: set[bytes] | None = None) -> list[list[str]]:
    """Names of the features that are on at each token."""
    words = [word(t) for t in tokens]
    words = [w if known is None or w in known else None for w in words]
    out = []
    for i, t in enumerate(tokens):
        f = list(shape(t))
        f.append(f"file={file}|{f[0]}")
        f += [f"w-{k}={words[i - k]!r}" for k in range(1, BEFORE + 1) if i >= k and words[i - k] is not None]
        if i + 1 < len(tokens) and words[i + 1] is not None:
            f.append(f"w+1={words[i + 1]!r}")
        out.append(f)
    return out


def train(examples: list[tuple[list[bytes], list[int], int]], passes: int = PASSES, seed: int = 11) -> Field | None:
    """Likelihood by gradient steps (Adagrad) over all windows; None without
    a tagged token."""
    if not any(any(tags) for _, tags, _ in examples):
        return None
    rng, more = random.Random(seed), []
    # words that stand near secrets of two windows or more are known by name
    near: dict[bytes, int] = {}
    for tokens, tags, _ in examples:
        for i, tag in enumerate(tags):
            if tag == BEGIN:
                for w in {word(t) for t in tokens[max(0, i - BEFORE):i] + tokens[i + 1:i + 2]}:
                    near[w] = near.get(w, 0) + 1
    known = {w for w, n in near.items() if n >= 2}
    for tokens, tags, file in examples:
        more.append((features(tokens, file, known), tags))
        if any(tags):
            other = redrawn(tokens, tags, rng)
            more += [(features(tokens, file, set()), tags), (features(other, file, known), tags)]
    names = {f: k + 1 for k, f in enumerate(sorted({f for x, _ in more for fs in x for f in fs}))}
    longest = max(len(t) for _, t in more)
    most = max(len(fs) for x, _ in more for fs in x)
    at = np.zeros((len(more), longest, most), np.int32)
    gold, length = np.zeros((len(more), longest), np.int64), np.array([len(t) for _, t in more])
    for s, (x, tags) in enumerate(more):
        for i, fs in enumerate(x):
            at[s, i, :len(fs)] = [names[f] for f in fs]
        gold[s, :len(tags)] = tags
    weights, moves, ends = np.zeros((len(names) + 1, 3)), np.zeros((3, 3)), np.zeros(3)
    sums = [np.full(a.shape, 1e-8) for a in (weights, moves, ends)]
    live = np.arange(longest) < length[:, None]
    hot = np.eye(3)[gold] * live[:, :, None]
    flat = at.ravel()
    for _ in range(passes):
        scores = weights[at].sum(2)
        p, pairs = _marginals(scores, moves, ends, length, live)
        error = (p - hot)
        grads = [np.stack([np.bincount(flat, np.repeat(error[:, :, c].ravel(), most), len(weights))
                           for c in range(3)], 1),
                 pairs - np.einsum("sta,stb->ab", hot[:, :-1] * live[:, 1:, None], hot[:, 1:]),
                 (p[:, 0] - hot[:, 0]).sum(0)]
        grads[0][0] = 0
        for value, grad, total in zip((weights, moves, ends), grads, sums):
            grad = grad / len(more) + DECAY * value
            total += grad * grad
            value -= RATE * grad / np.sqrt(total)
    return Field({f: weights[k] for f, k in names.items()}, moves, ends, known)


def _marginals(scores, moves, ends, length, live):
    """Tag probabilities per token, and expected moves, of padded windows."""
    n, steps, _ = scores.shape
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0] + ends
    for t in range(1, steps):
        forward[:, t] = np.where(live[:, t, None], _lse(forward[:, t - 1, :, None] + moves) + scores[:, t],
                                 forward[:, t - 1])
    for t in range(steps - 2, -1, -1):
        backward[:, t] = np.where(live[:, t + 1, None],
                                  _lse((moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :]).swapaxes(1, 2)), 0)
    total = _lse(forward[:, -1, :, None])[:, 0]
    p = np.exp(forward + backward - total[:, None, None]) * live[:, :, None]
    pairs = np.zeros((3, 3))
    for t in range(1, steps):
        x = forward[:, t - 1, :, None] + moves + (scores[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
        pairs += (np.exp(x) * live[:, t, None, None]).sum(0)
    return p, pairs


def _lse(x):
    """log sum exp over the axis before the last."""
    m = x.max(-2, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(-2, keepdims=True))).squeeze(-2)


# ----------------------------------------------------------------- decoding --
def viterbi(scores: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[int]:
    """The best tags; ``first`` and ``last`` are added at the two ends."""
    best, back = scores[0] + first, []
    for s in scores[1:]:
        step = best[:, None] + moves
        back.append(step.argmax(0))
        best = step.max(0) + s
    tags = [int((best + last).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


class Scores:
    """Scores of tokens under a field, by rows shared by equal tokens."""

    def __init__(self, field: Field):
        self.field, self.keys, self.plain = field, {}, {}
        self.of: _Rows = _Rows(self)
        self.tables = np.zeros((2 + BEFORE, 64, 3))
        self.files = np.zeros((FILE_KINDS, 64, 3))
        self.counts = np.zeros((2, 64), np.int64)

    def row(self, token: bytes) -> int:
        w = word(token)
        if w not in self.field.known and w.isalpha():
            # letters alone have the form of their classes
            classes = token.translate(_CLASSES)
            if classes not in self.plain:
                self.plain[classes] = self._keyed(token, w)
            return self.plain[classes]
        return self._keyed(token, w)

    def _keyed(self, token: bytes, w: bytes) -> int:
        key = (shape(token), w if w in self.field.known else None, w in _SIGNS)
        if key not in self.keys:
            k = self.keys[key] = len(self.keys)
            if k == self.tables.shape[1]:
                self.tables, self.files, self.counts = (
                    np.concatenate([a, np.zeros_like(a)], 1) for a in (self.tables, self.files, self.counts))
            get = self.field.weights.get
            zero = np.zeros(3)
            self.tables[0, k] = sum((get(f, zero) for f in key[0]), zero)
            if key[1] is not None:
                for b in range(1, BEFORE + 1):
                    self.tables[b, k] = get(f"w-{b}={key[1]!r}", zero)
                self.tables[-1, k] = get(f"w+1={key[1]!r}", zero)
            for f in range(FILE_KINDS):
                self.files[f, k] = get(f"file={f}|{key[0][0]}", zero)
            self.counts[:, k] = re.search(rb"\d", token) is not None, key[2]
        return self.keys[key]

    def score(self, rows: np.ndarray) -> np.ndarray:
        n = len(rows)
        kind = file_kind(*(int(c[rows].sum()) for c in self.counts), max(1, n))
        own, last = (self.tables[0] + self.files[kind])[rows], self.tables[-1]
        for b in range(1, BEFORE + 1):
            own[b:] += self.tables[b][rows[:n - b]] if n > b else 0
        own[:-1] += last[rows[1:]]
        return own

    def secrets(self, text: bytes) -> list[tuple[int, int]]:
        """Spans in bytes of the tokens tagged as secrets."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        if len(self.of) > KEEP_TOKENS:
            self.of.clear()
            self.plain.clear()
        scores = self.score(np.fromiter(map(self.of.__getitem__, tokens), np.int64, len(tokens)))
        tags = decode(scores, self.field)
        if not tags:
            return []
        places, spans, open_at = [m.span() for m in TOKEN.finditer(text)], [], None
        for i in sorted(tags):
            start, end = places[i]
            start += len(tokens[i]) - len(tokens[i].lstrip())
            if tags[i] == INSIDE and open_at == i - 1:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
            open_at = i
        return spans


class _Rows(dict):
    def __init__(self, scores: Scores):
        super().__init__()
        self.scores = scores

    def __missing__(self, token):
        k = self[token] = self.scores.row(token)
        return k


def decode(scores: np.ndarray, field: Field) -> dict[int, int]:
    """Tags other than outside, by place, of the best path."""
    unsure = np.flatnonzero(scores[:, OUT] - scores[:, BEGIN:].max(1) <= field.margin)
    if not len(unsure):
        return {}
    tags, n = {}, len(scores)
    for part in np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1):
        a, b = int(part[0]), int(part[-1]) + 1
        first = field.moves[OUT] if a else field.ends
        last = field.moves[:, OUT] if b < n else np.zeros(3)
        tags.update((a + i, t) for i, t in enumerate(viterbi(scores[a:b], field.moves, first, last)) if t != OUT)
    return tags


# ------------------------------------------------------------------- report --
def spans_of(text: bytes, scores: Scores | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes: the patterns' spans, and those of the
    field that touch none of them."""
    base = [s[:3] for s in base_spans(text)]
    added = []
    for start, end in scores.secrets(text) if scores else ():
        if not any(a < end and start < e for a, _, e in base):
            added.append((start, len(KINDS) - 1, end))
    return sorted(base + added)


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    places = sorted({p for s, _, e in spans for p in (s, e)})
    at, done, point = {}, 0, 0
    for p in places:
        point += len(text[done:p].decode())
        at[p], done = point, p
    return [(at[s], KINDS[k], at[e]) for s, k, e in spans]


def describe(text: bytes | None, scores: Scores | None) -> tuple:
    text = text or b""
    spans = in_code_points(text, spans_of(text, scores))

    def joined(which):
        return ",".join(f"{k}:{s}:{e}" for s, k, e in which)
    base = [s for s in spans if s[1] != "crf"]
    return (*(sum(k == kind for _, k, _ in base) for kind in KINDS[:3]),
            hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document: counts and checksum of the patterns' spans, and all
    spans. The field is learned from ``docs`` unless one is given."""
    field = field or train(sample(docs))

    def run(batches):
        scores = Scores(field) if field else None
        for b in batches:
            out = [describe(t, scores) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.string() if k > 2 else pa.int64()) for k, c in enumerate(zip(*out)))],
                names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCHEMA)
