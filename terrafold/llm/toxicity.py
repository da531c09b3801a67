"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings counts the character subsequences of lengths three and four
that they share, each occurrence weighted by ``decay`` for every character it skips,
up to ``GAPS``; it is divided by the norm of the weights of a string of that
length.  Insults with a gap or an inserted character keep most subsequences.

A sentence is seen as its windows: its words; words with signs between their
letters without these; runs of very short words, joined - ``i.d.i.o.t`` and
``i d i o t`` are both seen as one word, too.  The machine is a latent one: an
example is a sentence, represented by its strongest window.  Sentences of clean
documents are negative; of a toxic document those are positive that the machine of
the round before finds so, or at least the strongest (multiple-instance training).
The first round takes, in place of a machine, how much the documents' labels speak
for a word or its beginning.

Landmarks are windows of training sentences; a string is mapped to
``K_mm^(-1/2) k(string, landmarks)`` and a linear machine with squared hinge loss is
trained there.  The sum over landmarks is linear in the subsequences of a string, so
it is collapsed to one weight per (hashed) subsequence for scoring, which changes
no result.

A document's margin is that of its strongest window; a logistic curve over it, the
number of windows over the border and that of all windows, fitted to the training
documents weighted to the shares in the whole training fold, gives the score.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import columns_of, crc_mod, id_type, python_ready
from terrafold.llm.words import char_table, mixed, word_table

BITS = 18
#: Distances between neighbouring characters of a subsequence.
GAPS = ((1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (1, 1, 1), (1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 2))
DECAY = 0.6
LONGEST = 32
#: Parts of spaced letters: as long, and half as long.
SPACED = 12
#: Margin of a string that is like no landmark: clearly clean.
OFFSET = -1.0
EDGES = ".,;:!?\"'()[]{}<>|*_-~`#$%&+=/\\@^"
SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)|\n")
INNER = re.compile(r"[\W_]+")
#: Lengths of the beginnings of words that the first round looks at.
STEMS = range(4, 10)


def _parts(word: str, longest: int, step: int) -> list[str]:
    """The word, or overlapping parts of ``longest`` characters that cover all of an over-long one."""
    if len(word) <= longest:
        return [word]
    return [word[i : i + longest] for i in range(0, len(word) - longest + step, step)]


def windows_of(text: str) -> list[str]:
    """Lower-cased words without punctuation at their edges; words without signs inside; runs of single characters, and of very short words, joined.

    What is over-long comes as overlapping parts, spaced letters as short ones: an
    insult is to fill most of a part, wherever in the run it lies.
    """
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        letters = "".join(w if len(w) == 1 else " " for w in run).split()
        out.extend(p for x in letters if len(x) > 2 for p in _parts(x, SPACED, SPACED // 4))
        out.extend(p for x in letters if len(x) > SPACED for p in _parts(x, SPACED // 2, SPACED // 6))
        if len(run) > 2 and 2 * sum(len(w) == 1 for w in run) >= len(run) and len(letters[0]) < len(run):
            out.extend(_parts("".join(run), LONGEST, LONGEST // 2))
        run.clear()

    for w in text.lower().split():
        w = w.strip(EDGES)
        if len(w) > 2:
            if run:
                close()
            out += _parts(w, LONGEST, LONGEST // 2)
            if not w.isalnum():
                bare = INNER.sub("", w)
                if len(bare) > 2 and bare != w:
                    out += _parts(bare, LONGEST, LONGEST // 2)
        elif w:
            out.append(w)
            run.append(w)
    if run:
        close()
    return out


def _subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word index, hashed subsequence, weight), one block for each tuple of gaps."""
    chars, owner = char_table(words)
    for gaps in GAPS:
        places = np.cumsum((0, *gaps))
        span = int(places[-1])
        if len(chars) <= span:
            continue
        inside = np.flatnonzero(owner[:-span] == owner[span:])
        yield owner[inside], mixed(*[chars[inside + at] for at in places], bits=BITS), DECAY ** (span - len(gaps))


def _norms(words: list[str]) -> np.ndarray:
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    total = sum(DECAY ** (2 * (sum(gaps) - len(gaps))) * np.maximum(lengths - sum(gaps), 0) for gaps in GAPS)
    return np.sqrt(np.maximum(total, 1.0))


def word_margins(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of a word's subsequences over its norm."""
    total = np.zeros(len(words))
    for owner, feature, weight in _subsequences(words):
        total += weight * np.bincount(owner, weights[feature], len(words))
    return total / _norms(words) if len(words) else total


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of each word with each landmark."""
    norm = _norms(landmarks)
    own = list(_subsequences(landmarks))
    # Rows only for subsequences that a landmark has; row 0 is that of all others.
    present = np.unique(np.concatenate([f for _, f, _ in own])) if own else np.zeros(0, np.int64)
    row = np.zeros(1 << BITS, np.int32)
    row[present] = np.arange(1, len(present) + 1)
    table = np.zeros((len(present) + 1, len(landmarks)), np.float32)
    for owner, feature, weight in own:
        np.add.at(table, (row[feature], owner), weight / norm[owner])
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at in range(0, len(words), 500):
        part = words[at : at + 500]
        for owner, feature, weight in _subsequences(part):
            rows = table[row[feature]] * np.float32(weight)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[at + owner[starts]] += np.add.reduceat(rows, starts, axis=0)
        out[at : at + len(part)] /= _norms(part)[:, None].astype(np.float32)
    return out


@dataclass
class Model:
    """Weights by subsequence; logistic curve over (strongest window, log number of windows over the border, log number of windows)."""

    weights: np.ndarray
    curve: np.ndarray
    prior: float

    def features(self, texts: list[str]) -> np.ndarray:
        distinct, codes, bounds = word_table([windows_of(t) for t in texts])
        out = np.zeros((len(texts), 3))
        out[:, 0] = -2.0
        out[:, 2] = np.log1p(np.diff(bounds))
        if len(codes):
            margin = np.clip(word_margins(distinct, self.weights) + OFFSET, -2, 2)[codes]
            full = np.flatnonzero(np.diff(bounds))
            out[full, 0] = np.maximum.reduceat(margin, bounds[full])
            # One window over the border may be so by chance, the more so in a long text.
            out[full, 1] = np.log1p(np.add.reduceat((margin > 0).astype(float), bounds[full]))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.curve):
            return np.full(len(texts), self.prior)
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 40) -> np.ndarray:
    """Linear machine with the offset OFFSET, by Newton steps on the active rows."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    for _ in range(steps):
        on = y * (x @ w + OFFSET) < 1
        a = x[on]
        weighted = a * cost[on, None]
        new = np.linalg.solve(ridge + weighted.T @ a, weighted.T @ (y[on] - OFFSET))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w += np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * w), -2, 2)
    return w


def _spread(words: list[str], n: int, like: float) -> list[str]:
    """Up to ``n`` of the words in their order, passing over those whose kernel with one already taken is ``like`` or more."""
    taken: list[str] = []
    for at in range(0, len(words), 64):
        part = words[at : at + 64]
        near = kernel(part, taken).max(axis=1) if taken else np.zeros(len(part))
        own = kernel(part, part)
        fresh: list[int] = []
        for i in range(len(part)):
            if near[i] < like and all(own[i, j] < like for j in fresh):
                fresh.append(i)
        taken += [part[i] for i in fresh]
        if len(taken) >= n:
            break
    return taken[:n]


def _without_copies(docs: Iterable[list[str]], size: int = 16, shared: int = 4) -> list[int]:
    """Indices of the word lists that are no copies of earlier ones, by the smallest hashes of their four-word runs."""
    index: dict[int, int] = {}
    kept = []
    for i, words in enumerate(docs):
        runs = {zlib.crc32(" ".join(words[k : k + 4]).encode()) for k in range(max(1, len(words) - 3))}
        smallest = heapq.nsmallest(size, runs)
        near = Counter(index[h] for h in smallest if h in index)
        if not near or near.most_common(1)[0][1] < min(shared, len(smallest)):
            kept.append(i)
            for h in smallest:
                index.setdefault(h, i)
    return kept


def _stems(windows: list[str]) -> tuple[np.ndarray, int]:
    """(codes of the beginnings of each string and of all of it, number of codes); code 0 where it is shorter."""
    out = np.zeros((len(windows), len(STEMS) + 1), np.uint32)
    for i, w in enumerate(windows):
        out[i] = [zlib.crc32(w[:n].encode()) | 1 if len(w) > n else 0 for n in STEMS] + [zlib.crc32(f"{w}$".encode()) | 1]
    distinct, codes = np.unique(np.append(out.reshape(-1), np.uint32(0)), return_inverse=True)
    return codes[:-1].reshape(out.shape).astype(np.int32), len(distinct)


def _evidence(hits: np.ndarray, misses: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood of the documents that have a stem under their own share of label 1, against the common one; 0 where theirs is less."""
    own = hits / np.maximum(hits + misses, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = hits * np.log(own / share) + np.where(misses > 0, misses * np.log((1 - own) / (1 - share)), 0.0)
    return np.where(own > share, value, 0.0)


class Sentences:
    """Windows of the sentences of documents, as codes of distinct windows."""

    def __init__(self, texts: list[str]) -> None:
        known: dict[str, int] = {}
        codes, bounds, owner = array("i"), [0], []
        for i, text in enumerate(texts):
            for sentence in SENTENCE.split(text):
                codes.extend([known.setdefault(w, len(known)) for w in windows_of(sentence)])
                if len(codes) > bounds[-1]:
                    bounds.append(len(codes))
                    owner.append(i)
        self.windows, self.codes = list(known), np.frombuffer(codes, np.int32) if len(codes) else np.zeros(0, np.int32)
        self.bounds, self.owner = np.array(bounds), np.array(owner, np.int64)

    def strongest(self, value: np.ndarray) -> np.ndarray:
        """Code of the window with the largest value in each sentence; of equal ones the first."""
        if not len(self.owner):
            return np.zeros(0, np.int64)
        own = value[self.codes]
        most = np.maximum.reduceat(own, self.bounds[:-1])
        hit = np.flatnonzero(own == np.repeat(most, np.diff(self.bounds)))
        sentence = np.searchsorted(self.bounds, hit, side="right") - 1
        return self.codes[hit[np.flatnonzero(np.r_[True, np.diff(sentence) != 0])]]


def _weights(texts: list[str], y: np.ndarray, landmarks: int, rounds: int, negatives: int, seed: int) -> np.ndarray:
    """Weights of subsequences from labelled texts; all zero where nothing speaks for label 1."""
    rng = np.random.default_rng(seed)
    said, weights = Sentences(texts), np.zeros(1 << BITS)
    windows = said.windows
    if not windows or len(set(y)) < 2:
        return weights
    toxic = y[said.owner] == 1

    # Documents of either label that have a stem, and a window.
    stems, n_stems = _stems(windows)
    counts, seen = np.zeros((2, n_stems), np.int32), np.zeros((2, len(windows)), np.int32)
    starts = np.flatnonzero(np.r_[True, np.diff(said.owner) != 0])
    for at, to in zip(starts, [*starts[1:], len(said.owner)], strict=True):
        own = np.unique(said.codes[said.bounds[at] : said.bounds[to]])
        label = y[said.owner[at]]
        seen[label, own] += 1
        counts[label, np.unique(stems[own])] += 1
    counts[:, 0] = 0
    share = float(y.mean())
    sure = np.log(max(2, (counts[1] > 0).sum())) + 2  # evidence must outweigh the number of stems that were tried
    value = _evidence(counts[1], counts[0], share)[stems].max(axis=1)
    del stems, counts
    value[(_evidence(seen[1], seen[0], share) <= 0) & (seen[0] > 0)] = 0.0  # words of clean documents, whatever they begin with
    clear = value > sure
    common = np.argsort(-seen[0], kind="stable")[: landmarks // 4]
    negative = rng.permutation(np.flatnonzero(seen[0] > 0))[:negatives]
    for _ in range(rounds):
        chosen = said.strongest(value)
        best: dict[int, int] = {}  # of each toxic document: the sentence to be positive if none is clearly
        for k in np.flatnonzero(toxic):
            i = int(said.owner[k])
            if i not in best or value[chosen[k]] > value[chosen[best[i]]]:
                best[i] = int(k)
        # What more clean documents have than toxic ones is no example of the latter.
        positive = Counter(chosen[toxic & clear[chosen] & (seen[1] > seen[0])[chosen]].tolist())
        spare = {int(chosen[k]) for k in best.values() if not clear[chosen[k]] and seen[0][chosen[k]] == 0 and value[chosen[k]] > 0}
        strongest = np.unique(chosen[~toxic])
        strongest = strongest[np.argsort(-value[strongest], kind="stable")]
        negative = np.union1d(negative, strongest[:negatives])
        negative = negative[np.argsort(-value[negative], kind="stable")][: 2 * negatives]
        bad = [*positive, *sorted(spare - positive.keys())]
        if not bad:
            break
        hard = [w for w in negative.tolist() if w not in positive]
        order = sorted(positive, key=lambda w: (-positive[w], w)) or bad
        near = [w for w in strongest[: landmarks * 2].tolist() if w not in positive]
        marks = _spread([windows[w] for w in order], landmarks // 2, 0.9) + _spread([windows[w] for w in near], landmarks // 4, 0.9)
        marks = list(dict.fromkeys([*marks, *(windows[w] for w in common)]))
        gram = kernel(marks, marks)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        half = vectors[:, values > 1e-4 * values[-1]] / np.sqrt(values[values > 1e-4 * values[-1]])
        x = kernel([windows[w] for w in [*bad, *hard]], marks) @ half
        target = np.r_[np.ones(len(bad)), -np.ones(len(hard))]
        cost = np.r_[[40 * np.log1p(positive[w]) if w in positive else 2.0 for w in bad], 40 * np.log1p(seen[0][hard])]
        alpha = half @ _squared_hinge(x, target, cost)
        weights = np.zeros(1 << BITS)
        norm = _norms(marks)
        for owner, feature, weight in _subsequences(marks):
            np.add.at(weights, feature, weight * alpha[owner] / norm[owner])
        value = np.concatenate([word_margins(windows[at : at + 20_000], weights) for at in range(0, len(windows), 20_000)]) + OFFSET
        clear = value > 0
        value = value - value.min()  # a spare sentence is the strongest of its document, however weak
    return weights


def train(
    texts: list[str], labels: list[int], shares: tuple[float, float], landmarks: int = 240, rounds: int = 4, negatives: int = 12_000, seed: int = 7, folds: int = 2
) -> Model:
    """A model from labelled texts; ``shares`` are those of label 0 and 1 where it will be used.

    Copies among the texts are one example: they would lend weight to any word they
    hold.  Of the clean sentences' windows ``negatives`` drawn at random and the
    ``negatives`` strongest of each round come in as examples, of which the strongest
    2 * ``negatives`` stay.  The curve is fitted to all documents, each seen with the
    weights that the other ``folds`` - 1 parts of the documents give: weights fit
    their own documents too well.
    """
    prior = float(shares[1])
    if len(set(labels)) < 2:
        return Model(np.zeros(0), np.zeros(0), prior)
    kept = _without_copies(windows_of(t) for t in texts)
    texts, y = [texts[i] for i in kept], np.array([labels[i] for i in kept])
    how = (landmarks, rounds, negatives, seed)
    fold = np.zeros(len(y), np.int64)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        fold[own] = np.arange(len(own)) % folds
    if any(len(set(y[fold != k])) < 2 for k in range(folds)):
        return Model(np.zeros(0), np.zeros(0), prior)
    x = np.zeros((len(y), 3))
    for k in range(folds):
        model = Model(_weights([texts[i] for i in np.flatnonzero(fold != k)], y[fold != k], *how), np.zeros(0), prior)
        apart = np.flatnonzero(fold == k)
        for at in range(0, len(apart), 256):
            x[apart[at : at + 256]] = model.features([texts[i] for i in apart[at : at + 256]])
    n = np.bincount(y, minlength=2)
    model.curve = _logistic(x, y, np.where(y == 1, shares[1] / n[1], shares[0] / n[0]) * len(y))
    model.weights = _weights(texts, y, *how)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int = 6000) -> Model:
    """A model from at most ``train_rows`` labelled rows of those given, a third of them label 1 where there are as many.

    They are those with the smallest hashes of their ids.  An id with both labels
    has label 1.  Shares are taken over all labelled rows.
    """
    spark = docs.sparkSession
    known = columns_of(labels, id_col, label_col).where(f"`{id_col}` IS NOT NULL AND `{label_col}` IN (0, 1)")
    known = known.groupBy(f"`{id_col}`").agg(F.max(f"`{label_col}`").alias(label_col))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(f"`{label_col}`").cast("int")).count().collect()}
    if not counts:
        return Model(np.zeros(0), np.zeros(0), 0.0)
    picked = [
        known.where(F.col(f"`{label_col}`") == label).orderBy(F.xxhash64(F.col(f"`{id_col}`")), F.col(f"`{id_col}`")).limit(n)
        for label, n in ((1, train_rows // 3), (0, train_rows - train_rows // 3))
    ]
    ids = [(r[0], int(r[1])) for p in picked for r in p.collect()]
    sample = F.broadcast(spark.createDataFrame(ids, f"picked {id_type(labels, id_col)}, label int"))  # train_rows rows at most
    texts = columns_of(docs, id_col, text_col).join(sample, F.col(f"`{id_col}`") == F.col("picked"))
    rows = sorted((r[0], r[1], r[2] or "") for r in texts.select("picked", "label", F.col(f"`{text_col}`")).collect())
    total = sum(counts.values())
    return train([r[2] for r in rows], [r[1] for r in rows], (counts.get(0, 0) / total, counts.get(1, 0) / total))


def _score_batches(model: Model, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())],
                names=["id", "score", "predicted"],
            )

    return run


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
    train_rows: int = 6000,
    folds: int = 4,
    held_out: int = 2,
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Labels are learnt from rows whose crc32(id as text) mod ``folds`` is not
    ``held_out``; a score depends on the text alone.  Null and empty texts score
    as a text without words; without labels of both kinds every score is the
    share of label 1.  Rows labelled twice count once, as 1 if either is; ids keep
    their type, null ids are scored and are in no fold (``held_out`` false).  Extra
    columns are ignored.
    """
    spark = docs.sparkSession
    python_ready(spark)
    fold = crc_mod(F.col(f"`{id_col}`"), folds)
    model = fit(docs, labels.where(fold != held_out), id_col, text_col, label_col, train_rows)
    rows = columns_of(docs, id_col, text_col).select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("content")
    )
    scored = rows.mapInArrow(_score_batches(model, threshold), f"id {id_type(docs, id_col)}, score double, predicted int")
    return scored.select(
        F.col("id").alias(id_col), F.coalesce(crc_mod(F.col("id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def _keep_batches(model: Model, text_col: str, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([t or "" for t in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return run


def reject(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
    train_rows: int = 6000,
    folds: int = 4,
    held_out: int = 2,
) -> DataFrame:
    """``docs``, all columns, without the rows that :func:`score` predicts toxic: filtered where they are, without a join."""
    python_ready(docs.sparkSession)
    model = fit(docs, labels.where(crc_mod(F.col(f"`{id_col}`"), folds) != held_out), id_col, text_col, label_col, train_rows)
    return docs.mapInArrow(_keep_batches(model, text_col, threshold), docs.schema)
