"""Token ids by public tokenizer files, encoded chunk by chunk with a cache.

Byte-pair encoders first cut a text into pre-tokens that never span certain
white-space borders, so a text's ids are the ids of its chunks, one after
the other. Chunks repeat, so each distinct chunk is encoded once by the
library and kept; a document's ids are then one join of byte strings
(little-endian unsigned 32-bit ids). Arrow cuts the texts, finds the distinct
chunks of many texts at once and joins their ids, so Python sees a chunk once
for all of these. A text whose white space does not allow the cut is encoded
whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Where a space has white space before or after it, or the text starts or
# ends with white space, cutting at spaces could change pre-tokens.
_WHITE = "\t\n\x0b\x0c\r"
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_LATIN = "\x1c\x1d\x1e\x1f\x85\xa0"
# White space beside which a line feed is no pre-token of its own.
_FEEDS = ("\n\n", "\t", "\x0b", "\x0c", "\r")
_RUNS = re.compile(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+")

FIRST = "\x1c"      # in no text that is cut at its white space alone
KEEP_CHUNKS = 400_000
KEEP_CHARS = 48
# Signs that end a word. Letters and the signs after them are different
# pre-tokens; an apostrophe may start a pre-token with letters.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LONG_TAIL = 8


class Encoder:
    """Ids of texts under one tokenizer file.

    ``drops_space``: the tokenizer discards white space (word vocabularies),
    so words are the chunks; else a chunk is a word with the space before it.
    Signs after letters, and a single line feed between words, are pre-tokens
    of their own: their ids are put beside those of the letters.
    New chunks are encoded many at a time. Words of letters are set apart by
    their spaces alone; others by a bar after a space, which is a pre-token of
    its own with one id; chunks with a bar, and those that could join it
    because they start with a sign, are encoded alone.
    """

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.drops_space = drops_space
        self.joint = " | " if drops_space else " |"
        (self.mark_id,) = self._ids(" |")
        # tokens that end a word (word vocabularies) or start one after a space
        vocab = self.tokenizer.get_vocab()
        self.border = np.zeros(max(vocab.values()) + 1, bool)
        self.border[[i for t, i in vocab.items() if (t.endswith("</w>") if drops_space else t[0] == "\u0120")]] = True
        self.feed = self._whole("\n")
        self.signs: dict[str, bytes] = {}       # signs after letters -> ids
        self.known: dict[str, bytes] = {}       # word -> ids of the word (with a space before it)
        self.older: dict[str, bytes] = {}       # the generation before

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _whole(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def _together(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without the mark, in one call."""
        ids = np.array(self._ids(self.joint.join(chunks)), "<u4")
        at = np.flatnonzero(ids == self.mark_id)
        data, first, last = ids.tobytes(), np.r_[0, at + 1] * 4, np.r_[at, len(ids)] * 4
        return [data[a:b] for a, b in zip(first.tolist(), last.tolist())]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each with a space before it. Such a word
        is one pre-token, so it has one token that ends (or starts) a word;
        where the count differs, the words are set apart by bars."""
        ids = np.array(self._ids(" " + " ".join(words)), "<u4")
        at = np.flatnonzero(self.border[ids])
        if len(at) != len(words):
            return self._together([self._chunk(w) for w in words])
        cuts = (4 * (np.r_[0, at + 1] if self.drops_space else np.r_[at, len(ids)])).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encode(self, keys: list[str]):
        """(key, ids) of new chunks."""
        for part in _parts([k for k in keys if k.isalpha()], 20_000):
            yield from zip(part, self._letters(part))
        bars = []
        for k in keys:
            if not k.isalpha():
                c = self._chunk(k)
                if "|" not in c and (self.drops_space or c[0].isspace() or c[0].isalpha()):
                    bars.append(k)
                else:
                    yield k, self._whole(c)
        for part in _parts(bars, 20_000):
            yield from zip(part, self._together([self._chunk(k) for k in part]))

    def _cut(self, text: str) -> str | list[str] | None:
        """Keys of the chunks: words, or words with the space before them cut
        off; chunks as they are (the first word) are marked by a space. A text
        that is cut at its white space alone is given in one piece, with
        ``FIRST`` as that mark."""
        if not text:
            return []
        latin = _latin(text)
        odd = any(c in text for c in _ODD_LATIN) if latin else _ODD_SPACE.search(text)
        if self.drops_space:
            if odd:
                return [w.decode() for w in text.encode().split()]
            # the tokenizer lowers letters itself; where that is one to one
            # (Latin-1), words that differ by case share a chunk
            return text.lower() if latin else text
        if odd:
            return None
        if "  " in text or text[0].isspace() or text[-1].isspace() or any(
                " " + c in text or c + " " in text for c in _WHITE if c in text):
            return [" " + c for c in _RUNS.findall(text)]
        if "\n" in text and not any(x in text for x in _FEEDS):
            text = text.replace("\n", " \n")        # a word keeps the line feed before it
        return FIRST + text

    def _chunk(self, key: str) -> str:
        if self.drops_space:
            return key
        return key[1:] if key[0] == " " else " " + key

    def _parts_of(self, key: str) -> tuple[bytes, str, bytes] | None:
        """(ids before, key of the stem, ids after) of a word with a line feed
        before it or signs after its letters; else null."""
        head = b""
        if key[:1] == "\n" and not self.drops_space:
            head, key = self.feed, " " + key[1:]
            if key == " ":
                return head, "", b""
        stem = key.rstrip(_SIGNS)
        if len(stem) < len(key) <= len(stem) + _LONG_TAIL and (stem[1:] if stem[:1] == " " else stem).isalpha():
            tail = key[len(stem):]
            if tail not in self.signs:
                if len(self.signs) >= 10_000:
                    self.signs.clear()
                self.signs[tail] = self._whole(tail)
            return head, stem, self.signs[tail]
        return (head, key, b"") if head else None

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none) as little-endian 32-bit integers."""
        cut = [self._cut(t or "") for t in texts]
        if len(self.known) > KEEP_CHUNKS // 2:
            self.known, self.older = {}, self.known
        known, older, long = self.known, self.older, {}
        plain = pa.array([c for c in cut if isinstance(c, str)], pa.large_string())
        lists = pc.ascii_split_whitespace(plain) if self.drops_space else pc.split_pattern(plain, " ")
        words = lists.values.dictionary_encode()
        keys = [" " + k[1:] if k[:1] == FIRST else k for k in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        values = list(map(known.get, keys))
        gaps = [i for i, ids in enumerate(values) if ids is None]
        missing = {keys[i] for i in gaps}.union(*[c for c in cut if isinstance(c, list)]).difference(known, ("",))
        again = [w for w in missing if w in older]
        known.update((w, older[w]) for w in again)
        missing.difference_update(again)
        made = [(w, *parts) for w in missing if not w.isalpha() and (parts := self._parts_of(w))]
        missing.difference_update([w for w, *_ in made])
        stems = {stem for _, _, stem, _ in made if stem}.difference(known, missing)
        again = [w for w in stems if w in older]
        known.update((w, older[w]) for w in again)
        missing.update(stems.difference(again))
        for w, ids in self._encode(list(missing)):
            (known if len(w) <= KEEP_CHARS else long)[w] = ids
        for w, head, stem, tail in made:
            ids = head + (known[stem] if stem in known else long[stem] if stem else b"") + tail
            (known if len(w) <= KEEP_CHARS else long)[w] = ids
        table = known if not long else _Both(known, long)
        for i in gaps:
            values[i] = table[keys[i]] if keys[i] else b""
        ids = pa.array(values, pa.large_binary()).take(words.indices)
        plain = iter(_pieces(ids, lists.offsets))
        return [next(plain) if isinstance(c, str) else self._whole(t) if c is None
                else b"".join(map(table.__getitem__, c)) for t, c in zip(texts, cut)]


def _pieces(values: pa.Array, offsets: pa.Array):
    """The values between offsets, joined."""
    _, ends, data = values.buffers()
    if data is None:
        return [b""] * (len(offsets) - 1)
    at = np.frombuffer(ends, np.int64)[offsets.to_numpy()].tolist()
    data = memoryview(data)
    return [bytes(data[a:b]) for a, b in zip(at, at[1:])]


class _Both:
    def __init__(self, known: dict, long: dict):
        self.known, self.long = known, long

    def __getitem__(self, key):
        return self.known[key] if key in self.known else self.long[key]


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _parts(items: list, n: int):
    return (items[i:i + n] for i in range(0, len(items), n))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    key = (path, drops_space)
    if key not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[key] = Encoder(path, drops_space)
    return _ENCODERS[key]


def groups(texts: list[str | None], chars: int = 2_000_000):
    """Index ranges of texts of about ``chars`` characters each."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def forgetting(run, path: str, drops_space: bool):
    """``run`` over a task's batches, its remembered words dropped at the
    end: the worker outlives the task and would hold them while idle."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            encoder(path, drops_space).forget()
    return wrapped
