"""Ids put together from chunks equal those of the whole text."""

import random

import numpy as np
import public_tokenizers
import pytest

from veeduria.llm.tokens import Encoder

PIECES = ["a", "Bc", "é", "ñ", "'s", "'", "\n", "\n\n", " ", "  ", "\t", "|", ".", ",", "***", "_", "-", "1", "²", "漢",
          "́", "\r\n", "don't", "*foo", "Ġ", "🙂", " ", "x.", "end,", "$$$", "<|endoftext|>"]
WORDS = ["a", "B", "é", "***", ".", "|", "'s", "'", "\n", "\nX", "1", "-", '"', "́", "\n*", "," * 20]


@pytest.mark.parametrize("name,drops_space", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@pytest.mark.parametrize("keep", [400_000, 20])
def test_encoder_equals_whole_texts(name, drops_space, keep, monkeypatch):
    monkeypatch.setattr("veeduria.llm.tokens.KEEP_CHUNKS", keep)
    r = random.Random(11)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 25))) for _ in range(1500)]
    texts += [" ".join("".join(r.choices(WORDS, k=r.randint(1, 5))) for _ in range(8)).strip() for _ in range(1500)]
    texts += ["", "\n", "a\n", "\na", "a\nb", "a.\nB, c\n\nd", "x" * 3000 + ".\n" + "y" * 3000]
    e = Encoder(public_tokenizers.path(name), drops_space)
    got = [ids for i in range(0, len(texts), 50) for ids in e.encode(texts[i:i + 50])]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


@pytest.mark.parametrize("name, drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_chunks_are_looked_up_once_per_call(name, drops):
    e = Encoder(public_tokenizers.path(name), drops)
    texts = ["la casa\nque, la", "la\tcasa", "", None, "la  casa que", " que", "una casa", "\x1ccasa la", "la |casa|",
             "casa que,\nla CASA"] * 3
    asked = []

    class Counted(dict):
        def __getitem__(self, key):
            asked.append(key)
            return dict.__getitem__(self, key)
    want = [b"".join(np.array(i, "<u4").tobytes() for i in
                     [e.tokenizer.encode(t or "", add_special_tokens=False).ids]) for t in texts]
    e.known = Counted()
    assert e.encode(texts) == want
    e.known, plain = Counted(e.known), ["la casa que"] * 50
    asked.clear()
    assert e.encode(plain) == e.encode(plain[:1]) * 50 and len(asked) <= 10      # 150 words
    assert e.encode([]) == [] and e.encode(["", None]) == [b"", b""]
