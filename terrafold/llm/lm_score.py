"""Language-model scores: a causal self-attention model over subword ids, beside a base of word counts.

Words and subword ids of all training documents are counted in the cluster.  The
word counts give the base score.  The ids that occur get an input row and an output
each; the rest of the vocabulary shares one of either.

The model adds the rows of an id and of the two before it, lets each place look
back by one layer of masked self-attention, and has a feed-forward layer.  Its output
is a softmax over the most frequent ids and over tiers of rarer ones, then, for
targets in a tier, a softmax over that tier: a whole distribution over the
vocabulary in every context, at the price of a part of it.

It is started on the driver with a few documents and then trained in the cluster:
all training documents are dealt to shards of some ``SHARD_ROWS``, every shard takes
one pass over all of its windows, and the weights of the shards are averaged,
``TURNS`` times with other documents.  Every training document so reaches the weights;
documents and steps grow with the input, the driver's part does not.

A text is its lower-cased words, each with a space before it, and an end.  It is
scored in windows of ``WINDOW`` ids that overlap by ``CONTEXT``: each id is scored
once, in the window where at least ``CONTEXT`` ids (or all there are) precede it.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import columns_of, crc_mod, dropped, id_type, python_ready, written

WINDOW, CONTEXT = 32, 8
STRIDE = WINDOW - CONTEXT
WIDTH, KEY, HIDDEN = 24, 16, 48
#: Ids whose rows are added up at a place; ids of the first softmax; how much wider each further tier is.
LAGS, FIRST, WIDER = 3, 64, 1.5
SHARD_ROWS, TURNS, FAN = 2000, 2, 8
#: Windows in a step over a shard: the most that leave STEPS steps, between these two; the rate of a step for each of its windows.
BATCHES, STEPS, RATE = (96, 384), 200, 5e-3 / 96
#: Training rows of which one reaches the weights: all do, and nothing reads this any more but a test that sets it.
ONE_IN = 1
#: A word longer than this is cut into ids part by part.
PART = 1000

Batches = Iterator[pa.RecordBatch]


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word in order, bounds): words lie between spaces and the characters 9 to 13, A-Z lower-cased; text i has codes[bounds[i]:bounds[i + 1]]."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = parts.offsets.to_numpy()
    coded = parts.values.dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    blank = pc.index(words, "").as_py()
    if blank < 0:
        return words, codes[offsets[0] : offsets[-1]], offsets - offsets[0]
    # Texts that are empty, or begin or end with a space, give words without a character.
    real = codes != blank
    before = np.concatenate([[0], np.cumsum(real)])
    return words.take(pa.array(np.delete(np.arange(len(words)), blank))), codes[real] - (codes[real] > blank), before[offsets]


def subwords(path: str) -> tuple[Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], int]:
    """(ids of words with a space before each, one after the other, and how many each has; size of the vocabulary), for a file of ranks.

    Words longer than ``PART`` characters are cut into ids part by part.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    size = max(ranks.values()) + 1
    opens = np.zeros(size, bool)
    opens[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True

    def one(word: str) -> list[int]:
        word = " " + word
        return encode(word) if len(word) <= PART else [i for at in range(0, len(word), PART) for i in encode(word[at : at + PART])]

    def ids(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if pc.max(pc.utf8_length(words)).as_py() < PART:
            # The pattern cuts before every space, so all words are encoded at once: each begins at the id that has its space.
            flat = np.array(encode(" " + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()), np.uint32)
            starts = np.flatnonzero(opens[flat])
            if len(starts) == len(words):
                return flat, np.diff(np.append(starts, len(flat)))
        parts = [one(w) for w in words.to_pylist()]
        return np.array([i for part in parts for i in part], np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))

    return ids, size


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then the same from starts[1], and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def sequences_of(texts: pa.Array, ids_of: Callable, end: int) -> tuple[np.ndarray, np.ndarray, tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids of the texts one after the other, each with an end; their lengths; what :func:`word_codes` gives)."""
    words, codes, bounds = coded = word_codes(texts)
    flat, sizes = ids_of(words)
    own = sizes[codes]
    ids = flat[spread((np.cumsum(sizes) - sizes)[codes], own)]
    before = np.concatenate([[0], np.cumsum(own)])[bounds]
    lengths = np.diff(before) + 1
    out = np.full(int(lengths.sum()), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths - 1)] = ids
    return out, lengths, coded


class Vocabulary:
    """Places of the ids by falling count, and the tiers of the output.

    ``place[id]`` is an id's place, ``counts`` are in order of places.  Places below
    ``bounds[0]`` are in the first softmax, ``bounds[t]`` to ``bounds[t + 1]`` are tier
    ``t``; the last tier is of the ids that do not occur, which are equally likely.
    """

    def __init__(self, counts: np.ndarray) -> None:
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.place = np.empty(len(counts), np.int64)
        self.place[order] = np.arange(len(order))
        self.counts = counts[order]
        self.seen = int((counts > 0).sum())
        bounds, width = [min(FIRST, self.seen)], FIRST // 2
        while bounds[-1] < self.seen:
            bounds.append(min(self.seen, bounds[-1] + width))
            width = int(width * WIDER)
        self.bounds = np.array([*bounds, len(counts)])
        self.tiers = len(self.bounds) - 1
        # Of each place: 0 or one more than its tier, and its column in the first softmax.
        self.tier_of = np.searchsorted(self.bounds, np.arange(len(counts)), side="right").astype(np.uint8)
        self.column_of = np.where(self.tier_of == 0, np.arange(len(counts)), self.bounds[0] + self.tier_of.astype(np.int64) - 1)

    @property
    def end(self) -> int:
        """The id of the end of a text."""
        return len(self.place) - 1


def windows(ids: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(input rows (n, WINDOW), places of the targets (n, STRIDE), whether each is one, sequence of each window) of sequences of ids that follow each other."""
    unseen, begin, nothing = vocab.seen, vocab.seen + 1, vocab.seen + 2
    places = vocab.place[ids]
    n = -(-lengths // STRIDE)
    # One stream for all: before each text are CONTEXT places of nothing and a begin; it ends on a whole stride.
    at = (np.cumsum(n) - n) * STRIDE + np.arange(len(n)) * (CONTEXT + 1)
    stream = np.full(int(n.sum()) * STRIDE + len(n) * (CONTEXT + 1), nothing, np.int32)
    stream[at + CONTEXT] = begin
    own = spread(at + CONTEXT + 1, lengths)
    stream[own] = np.minimum(places, unseen)
    target = np.zeros(len(stream), np.int32)
    target[own] = places
    real = np.zeros(len(stream), bool)
    real[own] = True
    owner = np.repeat(np.arange(len(n)), n)
    start = np.arange(int(n.sum())) * STRIDE + owner * (CONTEXT + 1)
    late = start[:, None] + CONTEXT + 1 + np.arange(STRIDE)
    return stream[start[:, None] + np.arange(WINDOW)], target[late], real[late], owner


LAG_ROWS = [f"e{lag}" for lag in range(LAGS)]
CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))[CONTEXT:]


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _sums_by(keys: np.ndarray, values: np.ndarray, at: np.ndarray, often: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, the sum of values[at] for each): those of a frequent key are products with ones, which are faster."""
    order = np.argsort(keys.astype(np.uint16) if keys.max(initial=0) < 1 << 16 else keys, kind="stable")
    keys, values = keys[order], values[at[order]]
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    starts, counts = bounds[:-1], np.diff(bounds)
    sums = np.empty((len(starts), values.shape[1]), values.dtype)
    many = counts > often
    ones = np.ones(counts.max(initial=0), values.dtype)
    for i in np.flatnonzero(many).tolist():
        np.dot(ones[: counts[i]], values[starts[i] : bounds[i + 1]], out=sums[i])
    if not many.all():
        few = counts[~many]
        sums[~many] = np.add.reduceat(values[np.repeat(~many, counts)], np.cumsum(few) - few, axis=0)
    return keys[starts], sums


class Attention:
    """One layer of causal self-attention with a feed-forward layer, and the tiered output."""

    def __init__(self, vocab: Vocabulary, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, by=1.0: (rng.standard_normal(shape) * by / np.sqrt(shape[0])).astype(np.float32)
        self.vocab, bounds, mass = vocab, vocab.bounds, vocab.counts + 0.5
        tiers = [mass[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        heads = np.r_[mass[: bounds[0]], [max(t.sum(), 1e-9) for t in tiers]]
        self.p = {
            "at": normal(WINDOW, WIDTH, by=0.3),
            **{f"e{lag}": (rng.standard_normal((vocab.seen + 3, WIDTH)) * 0.3).astype(np.float32) for lag in range(LAGS)},
            "qkv": normal(WIDTH, 2 * KEY + WIDTH),
            "o": normal(WIDTH, WIDTH, by=0.5),
            "f": normal(WIDTH, HIDDEN),
            "g": normal(HIDDEN, WIDTH, by=0.5),
            "u": normal(WIDTH, len(heads), by=0.1),
            "b": np.log(heads / heads.sum()).astype(np.float32),
        }
        for t, own in enumerate(tiers[:-1]):
            self.p |= {f"u{t}": normal(WIDTH, len(own), by=0.1), f"b{t}": np.log(own / own.sum()).astype(np.float32)}

    def hidden(self, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """What the output is made from, (n * STRIDE, WIDTH), after each of the last STRIDE inputs of rows (n, WINDOW)."""
        p = self.p
        x = p["e0"].take(rows, axis=0, mode="clip")
        x += p["at"]
        for lag in range(1, LAGS):
            x[:, lag:] += p[f"e{lag}"].take(rows[:, :-lag], axis=0, mode="clip")
        y = (_flat(x) @ p["qkv"]).reshape(len(rows), WINDOW, -1)
        q, k, v = y[:, CONTEXT:, :KEY], y[:, :, KEY : 2 * KEY], y[:, :, 2 * KEY :]
        s = q @ k.transpose(0, 2, 1)
        with np.errstate(over="ignore", invalid="ignore"):
            e = np.exp(s)
            e *= CAUSAL
        total = (_flat(e) @ np.ones(WINDOW, e.dtype)).reshape(*e.shape[:2], 1)
        if not (total.min() > 1e-30 and total.max() < 1e30):  # far from each other: against the largest that may be seen
            s = np.where(CAUSAL > 0, s, -np.inf)
            e = np.exp(s - s.max(axis=2, keepdims=True)).astype(s.dtype)
            total = e.sum(axis=2, keepdims=True)
        c = e @ v
        c /= total
        h = _flat(c) @ p["o"]
        h += x[:, CONTEXT:].reshape(-1, WIDTH)
        a = h @ p["f"]
        np.maximum(a, 0, out=a)
        z = a @ p["g"]
        z += h
        if keep is not None:
            keep |= {"x": x, "q": q, "k": k, "v": v, "e": e, "total": total.reshape(-1, 1), "c": _flat(c), "h": h, "a": a}
        return z

    def _outputs(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Column of each target in the first softmax; (tier, rows with a target in it) for the tiers that have any."""
        vocab = self.vocab
        tier = vocab.tier_of.take(target)
        order = np.argsort(tier, kind="stable")
        ends = np.cumsum(np.bincount(tier, minlength=vocab.tiers + 1))
        parts = [(t, order[ends[t] : ends[t + 1]]) for t in range(vocab.tiers)]
        return vocab.column_of.take(target), [x for x in parts if len(x[1])]

    def log_probabilities(self, z: np.ndarray, target: np.ndarray, at_once: int = 1536) -> np.ndarray:
        """Natural logarithms of the probability of each target place."""
        p, vocab = self.p, self.vocab
        column, parts = self._outputs(target)

        def chosen(z: np.ndarray, u: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
            logits = z @ u
            logits += b
            own = logits[np.arange(len(at)), at]
            with np.errstate(over="ignore"):
                total = np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32)
            if np.isfinite(total).all() and total.min(initial=1.0) > 0:
                return own - np.log(total)
            logits = z @ u + b
            logits -= logits.max(axis=1, keepdims=True)
            return logits[np.arange(len(at)), at] - np.log(np.exp(logits).sum(axis=1))

        out = np.concatenate([chosen(z[i : i + at_once], p["u"], p["b"], column[i : i + at_once]) for i in range(0, len(z), at_once)])
        for t, rows in parts:
            if t == vocab.tiers - 1:
                out[rows] -= np.log(vocab.bounds[-1] - vocab.bounds[-2])
            else:
                out[rows] += chosen(z[rows], p[f"u{t}"], p[f"b{t}"], target[rows] - vocab.bounds[t])
        return out

    def gradient(self, rows: np.ndarray, target: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the real targets (n, STRIDE)."""
        g, used, sums = self.gradient_parts(rows, target, real)
        for lag, name in enumerate(LAG_ROWS):
            g[name] = np.zeros_like(self.p[name])
            g[name][used] = sums[:, lag * WIDTH : (lag + 1) * WIDTH]
        return g

    def gradient_parts(self, rows: np.ndarray, target: np.ndarray, real: np.ndarray, at_once: int = 96) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """:meth:`gradient` as (that of all but the input rows, input rows that occur, theirs side by side), worked out ``at_once`` windows at a time so that they stay in the cache."""
        p, vocab = self.p, self.vocab
        column, parts = self._outputs(target.reshape(-1))
        blocks = [slice(i, i + at_once) for i in range(0, len(rows), at_once)]
        kept: list[dict] = [{} for _ in blocks]
        z = np.ones((len(column), WIDTH + 1), p["u"].dtype)
        for block, m in zip(blocks, kept, strict=True):
            z[block.start * STRIDE : block.stop * STRIDE, :WIDTH] = self.hidden(rows[block], m)
        weight = (real.reshape(-1) / max(1, real.sum())).astype(z.dtype)

        def error(z: np.ndarray, u: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(gradient of z, that of u with the bias below it): the rows of z, which are shorter, are weighted instead of those of the logits."""
            e = z @ u
            ones = np.ones(e.shape[1], z.dtype)
            with np.errstate(over="ignore"):
                np.exp(e, out=e)
                total = e @ ones
            if not (total.min(initial=1.0) > 1e-30 and total.max(initial=1.0) < 1e30):  # far from each other: against the largest
                e = z @ u
                e -= e.max(axis=1, keepdims=True)
                np.exp(e, out=e)
                total = e @ ones
            e.reshape(-1)[np.arange(0, e.size, e.shape[1]) + at] -= total
            by = (weight / total)[:, None]
            d = e @ u[:-1].T
            d *= by
            return d, (z * by).T @ e

        g: dict[str, np.ndarray] = {}

        def add(name: str, value: np.ndarray) -> None:
            if name in g:
                g[name] += value
            else:
                g[name] = value

        dz = np.empty((len(z), WIDTH), z.dtype)
        u = np.concatenate([p["u"], p["b"][None]])
        for block in blocks:
            own = slice(block.start * STRIDE, block.stop * STRIDE)
            dz[own], of_first = error(z[own], u, column[own], weight[own])
            add("u", of_first)
        g["u"], g["b"] = g["u"][:-1], g["u"][-1]
        # The rows with a target in a tier lie tier by tier, so that they are fetched and put back once.
        parts = [x for x in parts if x[0] < vocab.tiers - 1]
        if parts:
            late = np.concatenate([own for _, own in parts])
            z_late, at_late, weight_late, d_late = z.take(late, axis=0), target.reshape(-1)[late], weight[late], np.empty((len(late), WIDTH), z.dtype)
            start = 0
            for t, own in parts:
                mine = slice(start, start := start + len(own))
                u = np.concatenate([p[f"u{t}"], p[f"b{t}"][None]])
                d_late[mine], of_tier = error(z_late[mine], u, at_late[mine] - vocab.bounds[t], weight_late[mine])
                g[f"u{t}"], g[f"b{t}"] = of_tier[:-1], of_tier[-1]
            dz[late] += d_late
        # Gradients of the inputs, after each window LAGS - 1 rows of zero: what an id's rows of all lags get lies side by side.
        ahead = np.zeros((len(rows), WINDOW + LAGS - 1, WIDTH), z.dtype)
        for block, m in zip(blocks, kept, strict=True):
            n = len(m["x"])
            d = dz[block.start * STRIDE : block.stop * STRIDE]
            da = d @ p["g"].T
            da *= m["a"] > 0
            add("g", m["a"].T @ d)
            add("f", m["h"].T @ da)
            dh = da @ p["f"].T
            dh += d
            add("o", m["c"].T @ dh)
            dc = dh @ p["o"].T
            dc /= m["total"]
            along = ((dc * m["c"]) @ np.ones(WIDTH, z.dtype)).reshape(n, STRIDE, 1)
            dc = dc.reshape(n, STRIDE, WIDTH)
            ds = dc @ m["v"].transpose(0, 2, 1)
            ds -= along
            ds *= m["e"]
            dy = np.empty((n, WINDOW, 2 * KEY + WIDTH), z.dtype)
            dy[:, :CONTEXT, :KEY] = 0
            dy[:, CONTEXT:, :KEY] = ds @ m["k"]
            dy[:, :, KEY : 2 * KEY] = ds.transpose(0, 2, 1) @ m["q"]
            dy[:, :, 2 * KEY :] = m["e"].transpose(0, 2, 1) @ dc
            add("qkv", _flat(m["x"]).T @ _flat(dy))
            dx = (_flat(dy) @ p["qkv"].T).reshape(m["x"].shape)
            dx[:, CONTEXT:] += dh.reshape(n, STRIDE, WIDTH)
            add("at", (np.ones(n, z.dtype) @ dx.reshape(n, -1)).reshape(WINDOW, WIDTH))
            ahead[block, :WINDOW] = dx
        flat, step = ahead.reshape(-1), ahead.strides[1]
        runs = np.lib.stride_tricks.as_strided(flat, (len(flat) // WIDTH - LAGS + 1, LAGS * WIDTH), (step, ahead.itemsize), writeable=False)
        of_window = (np.arange(len(rows)) * (WINDOW + LAGS - 1))[:, None] + np.arange(WINDOW)
        return g, *_sums_by(rows.reshape(-1), runs, of_window.reshape(-1))


def train(
    ids: np.ndarray, lengths: np.ndarray, vocab: Vocabulary, steps: int = 900, batch: int = 96, rate: float = 6e-3, seed: int = 3, model: Attention | None = None
) -> Attention:
    """By Adam on windows drawn from the sequences, each at most 30 times or so; a given model is trained on, by one pass over all windows.

    Input rows move only in steps that use them and without momentum, which would
    have to visit all rows in every step; their mean squares decay as in all others.
    """
    rng = np.random.default_rng(seed)
    rows, target, real, _ = windows(ids, lengths, vocab)
    once = None
    if model is None:
        model, steps = Attention(vocab, seed), min(steps, -(-30 * len(rows) // batch))
    else:
        once, steps = rng.permutation(len(rows)), -(-len(rows) // batch)
    # All weights side by side, so that a step is a few operations on long arrays.
    names = [k for k in model.p if k not in LAG_ROWS]
    ends = np.cumsum([model.p[k].size for k in names])
    flat = np.concatenate([model.p[k].reshape(-1) for k in names])
    place = {k: slice(end - model.p[k].size, end) for k, end in zip(names, ends.tolist(), strict=True)}
    inputs = [model.p[k].copy() for k in LAG_ROWS]
    squares, last = np.zeros((len(inputs[0]), LAGS * WIDTH), np.float32), np.zeros(len(inputs[0]), np.int64)
    model.p = {k: flat[place[k]].reshape(model.p[k].shape) for k in names} | dict(zip(LAG_ROWS, inputs, strict=True))
    first, second, value, scaled = (np.zeros_like(flat) for _ in range(4))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(rows), batch) if once is None else once[(step - 1) * batch : step * batch]
        slow = rate * min(1.0, step / 30) * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.99**step)
        now = slow / (1 - 0.9**step)
        got, used, own = model.gradient_parts(rows[pick], target[pick], real[pick])
        square = own * own
        square *= np.float32(0.01)
        square += squares[used] * (0.99 ** (step - last[used])).astype(np.float32)[:, None]
        squares[used], last[used] = square, step
        np.sqrt(square, out=square)
        square += np.float32(1e-8)
        own *= np.float32(slow)
        own /= square
        for lag, e in enumerate(inputs):
            e[used] -= own[:, lag * WIDTH : (lag + 1) * WIDTH]
        runs: list[slice] = []  # of weights that this batch has a gradient for; those of a tier without a target wait
        for name in (k for k in names if k in got):
            at = place[name]
            value[at] = got[name].reshape(-1)
            runs = [*runs[:-1], slice(runs[-1].start, at.stop)] if runs and runs[-1].stop == at.start else [*runs, at]
        for at in runs:
            m, v, g, h = first[at], second[at], value[at], scaled[at]
            m *= np.float32(0.9)
            np.multiply(g, np.float32(0.1), out=h)
            m += h
            v *= np.float32(0.99)
            g *= g
            g *= np.float32(0.01)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=h)
            h *= np.float32(now)
            flat[at] -= h
    return model


def log10_probabilities(ids: np.ndarray, lengths: np.ndarray, model: Attention, at_once: int = 64, together: int = 16) -> np.ndarray:
    """log10 probability of each sequence of ids (its end among them): the attention ``at_once`` windows at a time, the output for ``together`` such parts."""
    rows, target, real, owners = windows(ids, lengths, model.vocab)
    out = np.zeros(len(lengths))
    for at in range(0, len(rows), at_once * together):
        block = slice(at, at + at_once * together)
        z = np.concatenate([model.hidden(rows[i : i + at_once]) for i in range(at, min(len(rows), block.stop), at_once)])
        value = model.log_probabilities(z, target[block].reshape(-1)).reshape(-1, STRIDE)
        out += np.bincount(owners[block], np.where(real[block], value, 0).sum(axis=1), len(lengths))
    return out / np.log(10)


ENCODED = "id {id}, train boolean, ids binary, n_tokens long, part double, known long, rare array<struct<word:string,n:long>>"


def _count_words(most: int = 500_000) -> Callable[[Batches], Batches]:
    """(word, n) of a task's texts, added up until ``most`` distinct words are there; each text's end is the null word."""

    def run(batches: Batches) -> Batches:
        counted: list[pa.Table] = []
        rows = 0

        def summed() -> pa.Table:
            return pa.concat_tables(counted).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            words, codes, bounds = word_codes(batch.column("content"))
            n = np.append(np.bincount(codes, minlength=len(words)), len(bounds) - 1)
            counted.append(pa.table({"word": pa.concat_arrays([words, pa.nulls(1, pa.string())]), "n": pa.array(n, pa.int64())}))
            rows += len(n)
            if rows > most:
                counted, rows = [summed()], 0
                if len(counted[0]) > most:
                    yield from counted.pop().to_batches()
        if counted:
            yield from summed().to_batches()

    return run


def _encoded(path: str, frequent: tuple[pa.Array, np.ndarray], end: tuple[float, bool]) -> Callable[[Batches], Batches]:
    """Ids of the texts, end included.  ``frequent``: words and log10 of their base probability; a text's other words are passed on with their counts."""

    def run(batches: Batches) -> Batches:
        ids_of, size = subwords(path)
        value_of = np.append(frequent[1], np.nan)
        for batch in batches:
            ids, lengths, (words, codes, bounds) = sequences_of(batch.column("content"), ids_of, size)
            n = np.diff(bounds)
            value = value_of[pc.fill_null(pc.index_in(words, value_set=frequent[0]), len(frequent[0])).to_numpy()]
            owner, there = np.repeat(np.arange(len(n)), n), ~np.isnan(value)[codes]
            part = end[0] + np.bincount(owner[there], value[codes[there]], len(n))
            known = np.bincount(owner[there], minlength=len(n)) + int(end[1])
            # Words that are not frequent, once for each text: text and code in one number.
            rare, times = np.unique(owner[~there] * len(words) + codes[~there], return_counts=True)
            own = np.searchsorted(rare, np.arange(len(n) + 1) * len(words))
            left = pa.StructArray.from_arrays([words.take(pa.array(rare % max(1, len(words)))), pa.array(times, pa.int64())], names=["word", "n"])
            columns = [_binary(ids, lengths, size), pa.array(n + 1, pa.int64()), pa.array(part), pa.array(known, pa.int64()), pa.ListArray.from_arrays(pa.array(own, pa.int32()), left)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("train"), *columns], names=["id", "train", "ids", "n_tokens", "part", "known", "rare"]
            )

    return run


def _unit(size: int) -> str:
    """What an id is stored as: two bytes where all ids fit."""
    return "<u2" if size < 1 << 16 else "<u4"


def _binary(ids: np.ndarray, lengths: np.ndarray, size: int) -> pa.Array:
    """A binary value of ids for each length."""
    unit = np.dtype(_unit(size))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) * np.int32(unit.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(unit))])


def _ids(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after the other, lengths) of a binary column."""
    values = column.to_pylist()
    unit = np.dtype(_unit(size))
    return np.frombuffer(b"".join(values), unit), np.fromiter(map(len, values), np.int64, len(values)) // unit.itemsize


def _count_ids(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            total += np.bincount(_ids(batch.column("ids"), size)[0], minlength=size + 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["id", "n"])

    return run


def _packed(model: Attention, windows_seen: float, uses: np.ndarray) -> bytes:
    """Weights times the windows they saw; input rows times their uses, as other shards may not have them."""
    parts = [[windows_seen], uses]
    parts += [(model.p[k] * (uses[:, None] if k in LAG_ROWS else windows_seen)).reshape(-1) for k in sorted(model.p)]
    return np.concatenate(parts).astype(np.float32).tobytes()


def _unpacked(model: Attention, total: np.ndarray) -> Attention:
    """The means; an input row that no shard used stays as it was."""
    rows = model.vocab.seen + 3
    uses, at = total[1 : 1 + rows, None], 1 + rows
    new = {}
    for k in sorted(model.p):
        value = model.p[k]
        sums = total[at : at + value.size].reshape(value.shape)
        at += value.size
        new[k] = (np.where(uses > 0, sums / np.maximum(uses, 1), value) if k in LAG_ROWS else sums / total[0]).astype(np.float32)
    out = Attention(model.vocab)
    out.p = new
    return out


def _shard_weights(model: Attention, turn: int) -> Callable[[pa.Table], pa.Table]:
    def run(shard: pa.Table) -> pa.Table:
        rows = shard.sort_by([("row", "ascending"), ("ids", "ascending")])
        ids, lengths = _ids(rows.column("ids"), model.vocab.end)
        mine = Attention(model.vocab)
        mine.p = {k: v.copy() for k, v in model.p.items()}
        number = shard.column("shard")[0].as_py()
        batch = int(np.clip((-(-lengths // STRIDE)).sum() // STEPS, *BATCHES))
        mine = train(ids, lengths, model.vocab, batch=batch, rate=RATE * batch / (1 + turn), seed=number, model=mine)
        rows = windows(ids, lengths, model.vocab)[0]
        uses = np.bincount(rows.reshape(-1), minlength=model.vocab.seen + 3).astype(np.float64)
        return pa.table({"shard": pa.array([number], pa.int64()), "sums": pa.array([_packed(mine, float(len(rows)), uses)], pa.binary())})

    return run


def _add_weights(shards: pa.Table) -> pa.Table:
    rows = sorted(zip(shards.column("shard").to_pylist(), shards.column("sums").to_pylist(), strict=True))
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for _, x in rows)
    return pa.table({"shard": pa.array([rows[0][0] // FAN], pa.int64()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def trained_on(model: Attention, training: DataFrame) -> Attention:
    """``model`` after the shards have passed over all rows (id, ids), each in one of ``TURNS`` turns; the same however the rows are dealt to tasks.

    A shard's weights are added to those of ``FAN`` - 1 others, and so on until no more than ``FAN`` sums are left for the driver.
    """
    key = lambda name: F.xxhash64(F.lit(name), F.xxhash64("ids"), "id")
    dealt = training.select(key("shard").alias("row"), "ids", F.pmod(key("turn"), F.lit(TURNS)).alias("turn"))
    shards = max(1, training.count() // (SHARD_ROWS * TURNS))
    dealt = dealt.withColumn("shard", F.pmod("row", F.lit(shards)).cast("long"))
    for turn in range(TURNS):
        # A part for each shard: many small ones joined in a task would leave the others idle.
        mine = dealt.where(F.col("turn") == turn).drop("turn").repartition(shards, "shard")
        sums = mine.groupBy("shard").applyInArrow(_shard_weights(model, turn), "shard long, sums binary")
        left, spent = shards, []
        while left > FAN:
            spent.append(written(sums, "lm-sums"))
            sums = spent[-1].groupBy(F.floor(F.col("shard") / FAN)).applyInArrow(_add_weights, "shard long, sums binary")
            left = -(-left // FAN)
        got = sorted(sums.collect(), key=lambda r: r["shard"])
        for scratch in spent:
            dropped(scratch)
        if got:
            model = _unpacked(model, sum(np.frombuffer(r["sums"], np.float32).astype(np.float64) for r in got))
    return model


def _score_batches(model: Attention) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            scores = pa.array(log10_probabilities(*_ids(batch.column("ids"), model.vocab.end), model), pa.float64())
            kept = batch.select([n for n in batch.schema.names if n != "ids"])
            yield pa.RecordBatch.from_arrays([*kept.columns, scores], names=[*kept.schema.names, "score"])

    return run


def _log10(n: Column, below: float) -> Column:
    return F.log10((F.coalesce(n, F.lit(0)) + 0.5) / F.lit(below))


def score(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    held_out: int = 1,
    start_rows: int = 1500,
    start_ids: int = 20_000,
    frequent_words: int = 500_000,
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    All counts are over every row whose crc32(id as text) mod ``folds`` is not
    ``held_out``.  The attention is started with the ``start_rows`` of those rows
    with the smallest hashes of their texts that have no more than ``start_ids`` ids,
    and then trained on in the cluster, on all of them (:func:`trained_on`).  Words with at least one in ``frequent_words`` of the
    training tokens - no more than that many - go to the workers as a table, the
    rest is joined.  Null texts count as empty: the end alone.  Ids keep their type;
    null ids are in no fold and not trained on.  Without training rows the base is
    that of no counts at all, and every subword id is as likely as any other.
    Repeated rows each get their row.  Extra columns are ignored; texts are cut
    into ids once, and these are written to the shared folder.
    """
    spark = docs.sparkSession
    python_ready(spark)
    content = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("content")
    fold = F.coalesce(crc_mod(F.col(f"`{id_col}`"), folds) != held_out, F.lit(False)).alias("train")
    rows = columns_of(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), fold, content)
    partial = rows.where("train").select("content").mapInArrow(_count_words(), "word string, n long")
    counts = written(partial.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(totals["n"]), int(totals["v"])
    below = total + 0.5 * (distinct + 1)
    log = lambda n: float(np.log10((n + 0.5) / below))
    common = counts.where((F.col("n") >= max(1, total / frequent_words)) | F.col("word").isNull()).collect()
    ends = next((r["n"] for r in common if r["word"] is None), 0)
    named = [(r["word"], log(r["n"])) for r in common if r["word"] is not None]
    frequent = pa.array([w for w, _ in named], pa.string()), np.array([x for _, x in named])

    encoded = rows.mapInArrow(_encoded(ranks_path, frequent, (log(ends), ends > 0)), ENCODED.format(id=id_type(docs, id_col)))
    encoded = written(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    size = subwords(ranks_path)[1]
    training = encoded.where("train").select("id", "ids")
    mass = np.zeros(size + 1)
    for r in training.select("ids").mapInArrow(_count_ids(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        mass[r["id"]] = r["n"]  # no more rows than the vocabulary has
    vocab = Vocabulary(mass)
    # Hashes first: a sort of the rows would bring many more to the driver than it keeps.
    small = training.where(F.octet_length("ids") <= np.dtype(_unit(size)).itemsize * start_ids).select(F.xxhash64(F.lit("start"), "ids", "id").alias("h"), "ids")
    hashes = [r["h"] for r in small.select("h").orderBy("h").limit(start_rows).collect()]
    sample = small.where(F.col("h") <= hashes[-1]).limit(start_rows).collect() if hashes else []
    model = train(*_ids(pa.array([r["ids"] for r in sorted(sample)], pa.binary()), size), vocab)
    if ends:
        model = trained_on(model, training)

    kept = encoded.select("row", "id", "train", "n_tokens", "part", "known", "ids")
    scored = kept.mapInArrow(_score_batches(model), f"row long, id {id_type(docs, id_col)}, train boolean, n_tokens long, part double, known long, score double")
    rest = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    rest = rest.join(counts.where("word IS NOT NULL"), "word", "left")
    rest = rest.groupBy("row").agg(
        F.sum(F.col("times") * _log10(F.col("n"), below)).alias("rest"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known")
    )
    return scored.join(rest, "row", "left").select(
        F.col("id").alias(id_col),
        F.coalesce(crc_mod(F.col("id"), folds) == held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
    )
