"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are the n-grams (3 and 4 characters) of its lower-cased letters, words set apart by a
mark, hashed into BUCKETS rows of an embedding.  A text is the mean of its rows; a linear softmax on the
mean gives the languages.  Embedding and softmax are trained by stochastic gradient descent in numpy, on
a bounded sample of labelled texts (`SAMPLE`, the same number for every language where there are as
many); every n-gram of every text counts, in training and when predicting.  More languages than `SAMPLE` has room for are an error, so none goes unlearned silently.  For prediction embedding and softmax are
multiplied out into one row of language scores for each bucket.

A part of the sample is held back: it sets the temperature of the softmax (by the likelihood) and the
margin (log odds of the best language, before the temperature) below which a prediction is rejected.
`NEGATIVE` of negatives fall below it: held-back texts of languages that a model was not trained on (three
languages or more; up to four models, each without its share of the languages) and texts of shuffled
letters.  It is lowered so that at most `reject_most` of correct held-back texts fall below it, and raised where
`reject` of them do so anyway; with a sample too small to hold back from, it is not raised.  With a
single language only texts without letters are rejected.

Cases: a null text, or one with no letter, gets `und` with score 0 and is rejected; ties go to the
language that comes first by name; repeated rows give repeated results; with no labelled text at all
every text is `und`; empty tables give empty ones; other columns never matter to a prediction.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import blocks, crc32_text, give_back, mix, text_bytes

BUCKETS = 1 << 17
WIDTH = 16
GRAMS = (3, 4)
#: Labelled texts that the model is fitted on, at most; the texts with the lowest hash of their id.
SAMPLE = 2048
#: Texts a language that the sample must have room for.
LEAST_EACH = 8
EPOCHS = 4
#: The share of negatives that is to be rejected; of every how many texts one is shuffled to be one.
NEGATIVE, NOISE_EACH = 0.99, 4
_letters: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """For each code point its lower-case one if it is a letter, else 0."""
    if not _letters:
        out = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _letters.append(out)
    return _letters[0]


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-gram the buckets of the texts' n-grams end to end, and where each text's begin and end."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    if not len(data):
        return []
    raw = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    firsts = np.searchsorted(at, offsets)
    codes = letter_codes()[raw]
    text_of = np.repeat(np.arange(n), np.diff(firsts))
    # One mark between words: of a run of other characters only the first stays; each text begins with one.
    other = codes == 0
    kept = ~other
    kept[1:] |= other[1:] & ~other[:-1]
    starts = firsts[:-1][np.diff(firsts) > 0]
    kept[starts] = True
    codes[starts[~other[starts]]] |= 1 << 21  # a letter that begins its text, without a mark before it
    codes, text_of = codes[kept].astype(np.uint64), text_of[kept]
    edges = np.searchsorted(text_of, np.arange(n + 1))
    found = []
    for g in GRAMS:
        m = len(codes) - g + 1
        if m <= 0:
            continue
        h = np.full(m, g, dtype=np.uint64)
        good = text_of[:m] == text_of[g - 1 :]
        for k in range(g):
            part = codes[k : k + m]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += part
            if 0 < k < g - 1:
                good &= part != 0
        before = np.concatenate(([0], np.cumsum(good)))
        found.append(((mix(h[good]) & np.uint64(BUCKETS - 1)).astype(np.int64), before[np.minimum(edges, m)]))
    return found


def has_letter(texts: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.zeros(len(texts), dtype=bool)
    raw = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    firsts = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    total = np.concatenate(([0], np.cumsum(letter_codes()[raw] > 0)))
    return total[firsts[1:]] > total[firsts[:-1]]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # for each language the scores of all buckets
    bias: np.ndarray
    temperature: float
    least: float  # margins below are rejected

    def logits(self, parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        total, sizes = np.zeros((n, len(self.langs))), np.zeros(n)
        for buckets, bounds in parts:
            sizes += np.diff(bounds)
            for j in range(len(self.langs)):
                running = np.concatenate(([0.0], np.cumsum(self.table[j][buckets], dtype=np.float64)))
                total[:, j] += running[bounds[1:]] - running[bounds[:-1]]
        return total / np.maximum(sizes, 1)[:, None] + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, its score, and whether it is accepted, of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        logits = self.logits(features(texts), len(texts))
        p = softmax(logits / self.temperature)
        best, score = p.argmax(axis=1), p.max(axis=1)
        there = has_letter(texts)
        score = np.where(there, score, 0.0)
        return [self.langs[b] if t else "und" for b, t in zip(best, there)], score, there & (margins(logits) >= self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def margins(logits: np.ndarray) -> np.ndarray:
    """The log odds of the best language; of a single one infinite."""
    if logits.shape[1] < 2:
        return np.full(len(logits), np.inf)
    x = np.sort(logits, axis=1)
    top = x[:, -2:-1]
    return x[:, -1] - top[:, 0] - np.log(np.exp(x[:, :-1] - top).sum(axis=1))


def scores(rows: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The logits of texts given as distinct buckets with their shares."""
    return np.array([s @ table[b] if len(b) else np.zeros(len(bias)) for b, s in rows]).reshape(len(rows), len(bias)) + bias


def left_out(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, held: np.ndarray, n_langs: int) -> np.ndarray:
    """Margins of held-back texts under models that were not trained on their languages."""
    found, folds = [np.zeros(0)], min(4, n_langs) if n_langs > 2 else 0
    for k in range(folds):
        out = target % folds == k
        names, own = np.unique(target[~out & ~held], return_inverse=True)
        if len(names) < 2 or not (out & held).any():
            continue
        table, bias = sgd([rows[i] for i in np.flatnonzero(~out & ~held)], own, len(names))
        found.append(margins(scores([rows[i] for i in np.flatnonzero(out & held)], table, bias)))
    return np.concatenate(found)


def cutoff(right: np.ndarray, negative: np.ndarray, reject: float, most: float, raised: bool) -> float:
    """The margin that NEGATIVE of the negatives don't reach, between the `reject` and the `most` quantile of the right ones."""
    right = np.sort(right)
    if not len(right):
        return float(np.quantile(negative, NEGATIVE)) if len(negative) else -np.inf
    low, high = float(right[int(reject * len(right))]), float(right[int(most * len(right))])
    wanted = float(np.quantile(negative, NEGATIVE)) if len(negative) else low
    # Sums in another order differ in the last digits.
    return min(max(wanted, low) if raised else wanted, high) - 1e-3


def sgd(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, n_langs: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Train on texts given as distinct buckets with their shares; returns bucket scores and biases."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, n_langs), dtype=np.float32)
    bias = np.zeros(n_langs, dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = 1.0 * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            buckets, shares = rows[i]
            if not len(buckets):
                continue
            mean = shares @ embedding[buckets]
            p = softmax((mean @ out + bias)[None])[0]
            p[target[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            embedding[buckets] -= (rate * 20) * shares[:, None] * back
    return embedding @ out, bias


def sample(docs: DataFrame, most: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """At most about `most` labelled rows, spread evenly over the languages, chosen by a hash of the id."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    room = max(1, most // LEAST_EACH)
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).count().limit(room + 1).collect()
    if not counts:
        return labelled.limit(0)
    if len(counts) > room:
        raise ValueError(f"over {room} languages in {lang_col}; take a larger sample than {most}")
    each = most // len(counts)
    spread = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 30))
    wanted = F.lit(False)
    for lang, n in counts:
        wanted = wanted | ((F.col(lang_col) == lang) & (spread < F.lit(int(min(1.0, each / n) * (1 << 30)))))
    return labelled.where(wanted)


def fit(docs: DataFrame, most: int = SAMPLE, reject: float = 0.001, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reject_most: float = 0.01) -> Model:
    """A model of the languages named in the rows; only hashed counts of the sampled texts reach the driver."""
    picked = sample(docs, most, id_col, text_col, lang_col).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def counted(texts: pa.Array) -> list[pa.Array]:
        parts = features(texts)
        rows = [np.unique(np.concatenate([buckets[bounds[i] : bounds[i + 1]] for buckets, bounds in parts] or [np.zeros(0, dtype=np.int64)]), return_counts=True) for i in range(len(texts))]
        return [pa.array([r[k].astype("<u4").tobytes() for r in rows], pa.binary()) for k in (0, 1)]

    def shuffled(text: str) -> str:
        if zlib.crc32(text.encode()) % NOISE_EACH:
            return ""
        chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        return chars[np.random.default_rng(7).permutation(len(chars))].tobytes().decode("utf-32-le")

    def run(batches):
        for block in blocks(batches, "text"):
            noise = pa.array([shuffled(t) for t in block.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), block.column("lang"), *counted(block.column("text")), *counted(noise)],
                names=["id", "lang", "buckets", "counts", "noise", "noise_counts"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    found = picked.mapInArrow(run, f"id {kind}, lang string, buckets binary, counts binary, noise binary, noise_counts binary").toArrow()
    ids, names = found.column("id").to_pylist(), found.column("lang").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (str(ids[i]), names[i], found.column("buckets")[i].as_py()))
    langs = sorted(set(names))
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0), 1.0, 0.0)
    target = np.array([langs.index(names[i]) for i in order])

    def shares(buckets: str, counts: str) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for i in order:
            n = np.frombuffer(found.column(counts)[i].as_buffer(), dtype="<u4").astype(np.float32)
            out.append((np.frombuffer(found.column(buckets)[i].as_buffer(), dtype="<u4"), n / max(n.sum(), 1)))
        return out

    rows = shares("buckets", "counts")
    held = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), dtype=bool)
    table, bias = sgd([r for r, h in zip(rows, held) if not h], target[~held], len(langs))
    check = held if held.any() else ~held
    logits = scores([r for r, c in zip(rows, check) if c], table, bias)
    truth = target[check]
    likelihood = {t: float(np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-300).sum()) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    temperature = max(likelihood, key=likelihood.get)
    right = margins(logits)[logits.argmax(axis=1) == truth]
    noise = [r for r in shares("noise", "noise_counts") if len(r[0])]
    # Of each kind of negative the same share goes, however many there are.
    kinds = [x for x in (left_out(rows, target, held, len(langs)), margins(scores(noise, table, bias))) if len(x)]
    least = max([cutoff(right, x, reject, reject_most, bool(held.any())) for x in kinds or [np.zeros(0)]]) if len(langs) > 1 else -np.inf
    model = Model(langs, np.ascontiguousarray(table.T), bias, temperature, least)
    del found, rows, noise, table, logits
    give_back()  # the driver goes on without what the training took
    return model


def fold(id_col: str = "doc_id") -> F.Column:
    return crc32_text(F.col(id_col)) % 4


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and accepted of every row, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in blocks(batches, "text"):
            langs, score, accepted = sent.value.predict(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array(accepted)], names=["doc_id", "lang_pred", "score", "accepted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose language the model is sure of, with all their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in blocks(batches, text_col):
            yield block.filter(pa.array(sent.value.predict(block.column(text_col))[2]))

    return docs.mapInArrow(run, docs.schema)
