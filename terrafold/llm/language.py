"""Language identification by a linear-chain conditional random field over words.

Each word is labelled with a language; its emission scores are the sum of learned
weights of its affixes, character n-grams and its own form (the lexicon), hashed;
learned transitions tie neighbouring words.  Forward-backward gives each word's
marginals, so words of a code-switched text get their own labels; the language of
a document is the one with the largest sum of marginals over its letters, the
score its share.

A chain is a whole text.  Training follows the gradient of the chains' likelihood:
emissions by the marginals of words, transitions by those of pairs of words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from terrafold.llm.common import columns_of, crc_mod, id_type, python_ready
from terrafold.llm.words import char_table, mixed, word_table

BITS = 17
LONGEST = 40
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
APOSTROPHES = str.maketrans("", "", "'’")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters (Unicode's category L); over-long ones in parts."""
    out = []
    for w in WORD.findall(text.lower()):
        letters = w.isalpha() or w.translate(APOSTROPHES).isalpha()
        # Signs that count as numbers, such as fractions, are no letters.
        parts = [w] if letters else [x.strip("'’") for x in "".join(c if c.isalpha() or c in "'’" else " " for c in w).split()]
        out += [x[i : i + LONGEST] for x in parts for i in range(0, len(x), LONGEST)]
    return out


def _features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word index, hashed feature): n-grams of ``^word$`` of one to four characters (so affixes too) and the word itself."""
    chars, owner = char_table(words)
    for n in range(1, 5):
        if len(chars) < n:
            continue
        inside = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        size = np.full(len(inside), n, np.uint64)
        yield owner[inside], mixed(size, *[chars[inside + k] for k in range(n)], bits=BITS)
    position = np.arange(len(chars), dtype=np.uint64) - np.searchsorted(owner, owner).astype(np.uint64)
    form = (chars + np.uint64(7)) * (position * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)) ** np.uint64(3)
    whole = np.zeros(len(words), np.uint64)
    np.add.at(whole, owner, form)
    yield np.arange(len(words)), mixed(np.full(len(words), 9, np.uint64), whole, bits=BITS)


@dataclass
class Model:
    """Labels, emission weights (feature, label) and transitions (from, to)."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for owner, feature in _features(words):
            for k in range(len(self.labels)):
                out[:, k] += np.bincount(owner, self.weights[feature, k], len(words))
        return out

    def marginals(self, emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Marginals of all words; chain i covers rows starts[i] to starts[i] + lengths[i].

        Those of neighbouring words together are added up in ``pairs`` (from, to), where it is given.
        """
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        steps = int(lengths[0]) if len(lengths) else 0
        alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # chains longer than t
        local = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        tie = np.exp(self.transitions - self.transitions.max())
        forward, out = np.empty_like(local), np.empty_like(local)
        for t in range(steps):
            at = starts[: alive[t]] + t
            f = local[at] if t == 0 else local[at] * (forward[at - 1] @ tie)
            forward[at] = f / f.sum(axis=1, keepdims=True)
        backward = np.ones((len(starts), len(self.labels)), local.dtype)
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            at = starts[:n] + t
            m = forward[at] * backward[:n]
            out[at] = m / m.sum(axis=1, keepdims=True)
            ahead = local[at] * backward[:n]
            if pairs is not None and t:
                both = forward[at - 1][:, :, None] * tie * ahead[:, None, :]
                pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = ahead @ tie.T
            backward[:n] = b / b.sum(axis=1, keepdims=True)
        return out

    def label(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """(words of each text, marginals of all words, bounds of the texts in them)."""
        words = [words_of(t) for t in texts]
        distinct, codes, bounds = word_table(words)
        if not len(codes):
            return words, np.zeros((0, len(self.labels)), np.float32), bounds
        full = np.flatnonzero(np.diff(bounds))
        return words, self.marginals(self.emissions(distinct)[codes], bounds[full], np.diff(bounds)[full]), bounds

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.labels:
            return names, scores
        words, marginals, bounds = self.label(texts)
        if len(marginals):
            weight = np.fromiter((len(w) for ws in words for w in ws), np.float64, len(marginals))
            full = np.flatnonzero(np.diff(bounds))
            sums = np.add.reduceat(marginals * weight[:, None], bounds[full], axis=0)
            best = sums.argmax(axis=1)
            for i, k, share in zip(full, best, sums.max(axis=1) / sums.sum(axis=1), strict=True):
                names[i], scores[i] = self.labels[k], min(1.0, float(share))
        return names, scores


def gradient(model: Model, codes: np.ndarray, bounds: np.ndarray, distinct: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of minus the log-likelihood of labels ``y``: (distinct word, label) for the emissions, (from, to) for the transitions."""
    pairs = np.zeros_like(model.transitions, dtype=np.float64)
    p = model.marginals(model.emissions(distinct)[codes], bounds[:-1], np.diff(bounds), pairs)
    p[np.arange(len(y)), y] -= 1
    by_word = np.stack([np.bincount(codes, p[:, k], len(distinct)) for k in range(len(model.labels))], axis=1)
    inner = np.ones(len(y), bool)
    inner[bounds[1:] - 1] = False
    left = np.flatnonzero(inner)
    np.subtract.at(pairs, (y[left], y[left + 1]), 1)
    return by_word, pairs


def train(
    texts: list[str], labels: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.3, longest: int = 256, stretches: int = 4, seed: int = 11
) -> Model:
    """A model from texts whose words all have the text's label; by AdaGrad on the likelihood of the chains.

    A chain is a stretch of at most ``longest`` words; in each epoch a text gives all
    of its own, or ``stretches`` of them drawn at random, so that long texts do not
    outweigh the rest.  Where training texts are of one language each, transitions
    are learnt from pairs of them put next to each other, too.
    """
    names = sorted(set(labels))
    model = Model(names, np.zeros((1 << BITS, len(names)), np.float32), np.eye(len(names), dtype=np.float32))
    if len(names) < 2:
        return model
    rng = np.random.default_rng(seed)
    known = {n: k for k, n in enumerate(names)}
    docs = [([w[i : i + longest] for i in range(0, len(w), longest)], known[y]) for w, y in ((words_of(t), y) for t, y in zip(texts, labels, strict=True))]
    grad_w, grad_t = np.full_like(model.weights, 1e-6), np.full_like(model.transitions, 1e-6)
    for _ in range(epochs):
        drawn = [(x, y) for own, y in docs for x in (own if len(own) <= stretches else [own[i] for i in rng.choice(len(own), stretches, replace=False)])]
        order = rng.permutation(len(drawn))
        for at in range(0, len(order), batch):
            chains, targets = [], []
            part = [drawn[i] for i in order[at : at + batch]]
            for k, (words, y) in enumerate(part):
                truth = [y] * len(words)
                if k % 4 == 0:  # code-switched: the beginning of another stretch follows, then the first goes on
                    other, z = part[(k + 1) % len(part)]
                    words, truth = words[:32] + other[:32] + words[32:], truth[:32] + [z] * len(other[:32]) + truth[32:]
                chains.append(words)
                targets.append(truth)
            distinct, codes, bounds = word_table(chains)
            y = np.concatenate([np.array(t, np.int64) for t in targets])
            by_word, pairs = gradient(model, codes, bounds, distinct, y)
            by_word, g = by_word / len(y) * 64, pairs / len(y) * 64
            grad_t += g**2
            model.transitions -= (rate * g / np.sqrt(grad_t)).astype(np.float32)
            for owner, feature in _features(distinct):
                g = np.stack([np.bincount(feature, by_word[owner, k], 1 << BITS) for k in range(len(names))], axis=1)
                hit = np.flatnonzero(np.abs(g).sum(axis=1))
                grad_w[hit] += g[hit] ** 2
                model.weights[hit] -= rate * g[hit] / np.sqrt(grad_w[hit])
    return model


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_rows: int = 3000, most_labels: int = 1000) -> Model:
    """A model from at most ``train_rows`` rows with a language, as many of each (no more than 1000): those with the smallest hashes of their ids.

    More than ``most_labels`` languages are an error.
    """
    rows = columns_of(docs, id_col, text_col, lang_col).toDF("id", "text", "lang").where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    # Up to that limit Spark keeps each language's first rows where they are read, before they are shuffled.
    each = min(1000, train_rows)
    first = rows.select("id", "lang").withColumn("place", place).where(F.col("place") <= each).limit(each * most_labels + 1).collect()
    names = sorted({r["lang"] for r in first})
    if len(names) > most_labels:
        raise ValueError(f"more than {most_labels} languages")
    each = max(1, train_rows // max(1, len(names)))
    ids = [(r["id"], r["lang"]) for r in first if r["place"] <= each]
    sample: list[tuple[str, str]] = []
    if ids:
        schema = StructType([StructField("picked", rows.schema["id"].dataType), StructField("name", rows.schema["lang"].dataType)])
        chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, schema).distinct())  # train_rows rows at most
        got = rows.join(chosen, (F.col("id") == F.col("picked")) & (F.col("lang") == F.col("name")))
        sample = sorted((r["name"], r["text"]) for r in got.select("text", "name").collect())
    return train([t for _, t in sample], [name for name, _ in sample])


def _predict_batches(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict([t or "" for t in batch.column("content").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"]
            )

    return run


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_rows: int = 3000,
    folds: int = 4,
    held_out: int = 2,
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    Learns from text and non-null language of rows whose crc32(id as text) mod
    ``folds`` is not ``held_out``; a prediction depends on the text alone.  A null
    text, or one without a letter, is ``und`` with score 0, and so is every text
    when there is nothing to learn from.  Ids keep their type; null ids are in no
    fold.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    python_ready(spark)
    model = fit(docs.where(crc_mod(F.col(f"`{id_col}`"), folds) != held_out), id_col, text_col, lang_col, train_rows)
    rows = columns_of(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("content"))
    predicted = rows.mapInArrow(_predict_batches(model), f"id {id_type(docs, id_col)}, lang_pred string, score double")
    return predicted.select(
        F.col("id").alias(id_col), F.coalesce(crc_mod(F.col("id"), folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
