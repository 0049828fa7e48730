"""Language identification: averaged hashed subword embeddings, linear softmax.

A word, lower-cased and marked at both ends, gives its byte n-grams of 2 to
4 bytes, hashed to ``BUCKETS`` buckets. The average of the bucket embeddings
over a whole text goes through a linear softmax. Embeddings and weights are
trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows: about ``PER_LANG`` documents of each language (chosen by
hash), each as a whole text and as one short span, so that short texts are
met in training. A fifth of the sample is kept back to fit the temperature
of the softmax and the score below which a document is rejected: the score
under which only ``LOST`` of the rightly named texts lie, ``MOST`` at most.

Learned from: text and non-null language of rows whose crc32(doc_id as
text) mod 5 is not 0. A prediction reads the text alone.

Defined results: a text that is null or has no letter is ``und`` with score
0 and rejected; rows with null ids are predicted but not learned from; with
no labelled row every text is ``und`` with score 0 and only texts without a
letter are rejected; with one language every text has it; repeated rows get
equal predictions; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veeduria.llm.common import has_letter, release, tidy
from veeduria.llm.tokens import groups

BUCKETS = 1 << 15
DIM = 16
PER_LANG = 600
SPAN = 8
EPOCHS = 12
LOST = 0.001
MOST = 0.5
#: Bounds of a task's working memory: characters of text scored together (one
#: text at least) and distinct words embedded at a time. Results do not depend
#: on them.
TEXT_AT_ONCE = 1_000_000
WORDS_AT_ONCE = 4096
_SIZES = (2, 3, 4)


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, index of its word) for marked words."""
    data = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))      # bytes to the word's end
    buckets, owners, h = [], [], data.copy()
    for n in range(2, max(_SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) + data[n - 1:]
        inside = left[:len(h)] >= n
        x = h[inside] * np.uint32(0x85EBCA6B) + np.uint32(n)
        buckets.append(((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(17)) % BUCKETS)
        owners.append(owner[:len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def split(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def counted(words: list[bytes]) -> tuple[list[int], list[float]]:
    """Distinct buckets of a text and their share of its n-grams."""
    b, n = np.unique(ngrams(words)[0], return_counts=True)
    return b.tolist(), (n / n.sum()).tolist()


class Model:
    def __init__(self, langs: list[str], embeddings, weights, bias, temperature: float, accept: float):
        self.langs, self.embeddings, self.weights, self.bias = langs, embeddings, weights, bias
        self.temperature, self.accept = temperature, accept

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities of each language for texts that have a word."""
        ids: dict[bytes, int] = {}
        rows = [np.fromiter([ids.setdefault(w, len(ids)) for w in split(t)], np.int64) for t in texts]
        vectors = np.zeros((len(ids), DIM), np.float32)
        sizes = np.zeros(len(ids), np.int64)
        words = list(ids)
        for i in range(0, len(words), WORDS_AT_ONCE):
            buckets, owner = ngrams(words[i:i + WORDS_AT_ONCE])
            order = np.argsort(owner, kind="stable")
            n = np.bincount(owner)
            starts = np.cumsum(n) - n
            vectors[i:i + len(n)] = np.add.reduceat(self.embeddings[buckets[order]], starts, axis=0)
            sizes[i:i + len(n)] = n
        mean = np.stack([vectors[r].sum(axis=0, dtype=np.float64) / sizes[r].sum() for r in rows])
        return softmax((mean @ self.weights + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> list:
    """About ``per_lang`` labelled documents of each language, as bucket
    shares of the whole text and of one short span (bounded rows)."""
    seen = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid"))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    chosen = seen.where(F.pmod(h, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text", h.alias("h"))

    def features(batches):
        for b in batches:
            rows = []
            for lang, text, h in zip(*[c.to_pylist() for c in b.columns]):
                words = split(text)
                if words and has_letter(text):
                    at = h % len(words)
                    rows += [(lang, h, *counted(words)), (lang, h, *counted(words[at:at + SPAN]))]
            cols = list(zip(*rows)) if rows else [()] * 4
            types = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["lang", "h", "buckets", "shares"])
    got = chosen.mapInArrow(tidy(features), "lang string, h long, buckets array<int>, shares array<float>").toArrow()
    rows = [(lang, h, np.asarray(b.values), np.asarray(s.values)) for lang, h, b, s in
            zip(got["lang"].to_pylist(), got["h"].to_pylist(), got["buckets"], got["shares"])]
    return sorted(rows, key=lambda r: (r[1], r[0], len(r[2]), r[2].tobytes()))


def train(rows: list, epochs: int = EPOCHS, rate: float = 0.3, seed: int = 7) -> Model | None:
    """Stochastic gradient descent over the sample, one text at a time."""
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    kept_back = [r for r in rows if r[1] // 7 % 5 == 0] or rows
    fit = [r for r in rows if r[1] // 7 % 5] or rows
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = rng.normal(0, 0.5, (DIM, len(langs))), np.zeros(len(langs))
    number = {k: i for i, k in enumerate(langs)}
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(fit)):
            lang, _, buckets, shares = fit[i]
            mean = shares @ embeddings[buckets]
            g = softmax(mean @ weights + bias)
            g[number[lang]] -= 1
            back = weights @ g
            # frequent buckets have small shares: scaled so that an average of
            # many of them still moves
            embeddings[buckets] -= (step * 20 * shares)[:, None] * back[None, :].astype(np.float32)
            weights -= step * np.outer(mean, g)
            bias -= 0.1 * step * g
    logits = np.stack([s @ embeddings[b] for _, _, b, s in kept_back]) @ weights + bias
    truth = np.array([number[r[0]] for r in kept_back])

    def loss(t):
        return -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()

    temperature = min((float(t) for t in np.geomspace(0.2, 8, 60)), key=loss)
    p = softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    accept = min(MOST, float(np.quantile(right, LOST))) if len(right) else 0.0
    return Model(langs, embeddings, weights, bias, temperature, accept)


def predictor(model: Model | None):
    """Arrow UDF text -> (lang_pred, score, accepted)."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("lang_pred string, score double, accepted boolean")
    def predict(texts: pa.Array) -> pa.Array:
        values = [t if t and has_letter(t) else None for t in texts.to_pylist()]
        lang, score = ["und"] * len(values), [0.0] * len(values)
        accepted = [v is not None for v in values]
        known = [i for i, v in enumerate(values) if v is not None] if model else []
        for lo, hi in groups([values[i] for i in known], TEXT_AT_ONCE):
            rows = known[lo:hi]
            p = model.scores([values[i] for i in rows])
            for i, best, s in zip(rows, p.argmax(axis=1), p.max(axis=1)):
                lang[i], score[i], accepted[i] = model.langs[best], float(s), bool(s >= model.accept)
        release()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                           pa.array(accepted, pa.bool_())], names=["lang_pred", "score", "accepted"])
    return predict


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, accepted."""
    predict = predictor(train(sample(docs, per_lang)))
    x = docs.select("doc_id", predict(F.col("text")).alias("p"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return x.select("doc_id", held_out.alias("held_out"), "p.lang_pred", "p.score", "p.accepted")


def keep_identified(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""
    predict = predictor(train(sample(docs, per_lang)))
    return docs.where(predict(F.col("text"))["accepted"])
