"""BPE encoding and decoding by tree concatenation.

A text is a tree whose leaves hold at most ``leaf_chars`` characters.  Leaves are
rows of their own, encoded in parallel; neighbours are then joined level by level.

* At white space a join is exact as it stands: the normaliser and the splitting
  pattern of the tokenizers taken here keep no token across it.
* Inside a stretch that the pattern leaves whole (letters without end, a line of
  signs) the last tokens of the left side and the first of the right are encoded
  again, in windows that double until the window's outermost token on either
  side is the one that was there.  Then every two neighbouring tokens are what BPE
  makes of their characters alone, and for merges that only use what earlier
  merges made, that holds for the one encoding of the whole and for no other.
  Files whose merges are not like that are refused.

Decoding gives what the library's ``decode(ids, skip_special_tokens=False)`` gives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import columns_of, id_type, python_ready

#: Kinds of leaves: text that ends at white space, split words, inner and last parts of one word.
TEXT, WORDS, PART, LAST = range(4)
#: White space at which texts are cut.
SPACE = re.compile(r"[ \t-\r]+")
#: What the splitting pattern does to runs of these characters is simple enough to do here.
PRINTABLE = re.compile(r"[!-~]+")
#: The library's own pattern for such runs, in lower case.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: The tokenizer files that this takes have this pattern; others may keep tokens across white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Runs and words that a worker remembers before it starts anew.
REMEMBERED = 150_000


class WordBpe:
    """A tokenizer file: encoder of runs without white space, of parts of words, and decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec, path)
        self.whole = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.inner = Tokenizer.from_str(json.dumps(spec | {"model": spec["model"] | {"end_of_word_suffix": None}})).model
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = self.whole.get_vocab_size(with_added_tokens=True)
        tokens = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.tokens = [tokens.get(i, "") for i in range(max([size, *(i + 1 for i in tokens)]))]
        self.token_array = pa.array(self.tokens, pa.large_string())
        self.runs: dict[str, np.ndarray] = {}
        self.pieces: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one split word in the byte alphabet."""
        return [t.id for t in self.whole.model.tokenize(word)]

    def part(self, part: str, last: bool) -> list[int]:
        return [t.id for t in (self.whole.model if last else self.inner).tokenize(part)]

    def _plain(self, run: str) -> list[int]:
        out: list[int] = []
        for piece in PIECES.findall(run.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.pieces[piece] = self.word(piece)
            out += ids
        return out

    def encode_runs(self, runs: list[str]) -> list[np.ndarray]:
        """Ids of each run without white space."""
        if len(self.runs) > REMEMBERED:
            self.runs = {}
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        known, odd = self.runs, []
        for run in runs:
            if run not in known:
                if PRINTABLE.fullmatch(run) and not self.special.search(run):
                    known[run] = np.array(self._plain(run), np.uint32)
                else:
                    odd.append(run)
        for run, e in zip(odd, self.whole.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            known[run] = np.array(e.ids, np.uint32)
        return [known[run] for run in runs]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds): distinct runs are encoded once."""
        runs = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = runs.flatten().dictionary_encode()
        ids = self.encode_runs(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        held = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(flat)).take(pa.array(which))
        per_run = np.concatenate([[0], np.cumsum(sizes[which])])
        return held.flatten().to_numpy(zero_copy_only=False), per_run[runs.offsets.to_numpy()]

    def split(self, run: str) -> list[str | int]:
        """Words of a run in the byte alphabet; special strings are ids."""
        out: list[str | int] = []
        at = 0
        for m in [*self.special.finditer(run), None]:
            plain = run[at : m.start()] if m else run[at:]
            if plain:
                out += [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(plain))]
            if m:
                out.append(self.special_ids[m[0]])
                at = m.end()
        return out

    def window(self, left: np.ndarray, right: np.ndarray, last: bool) -> np.ndarray:
        """The ids of two parts of a word as one; ``last``: the right one ends the word."""
        k = 4
        while True:
            a, b = left[max(0, len(left) - k) :], right[:k]
            ends = last and k >= len(right)
            text = "".join([self.tokens[i] for i in a] + [self.tokens[i] for i in b])
            if ends and len(right):
                text = text.removesuffix(self.suffix)
            ids = self.part(text, ends)
            left_agrees = k >= len(left) or bool(ids) and ids[0] == a[0]
            right_agrees = k >= len(right) or bool(ids) and ids[-1] == b[-1]
            if left_agrees and right_agrees:
                return np.concatenate([left[: len(left) - len(a)], np.array(ids, np.uint32), right[len(b) :]])
            k *= 2

    def joined(self, leaves: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """The ids of a text from its leaves, neighbours joined level by level."""
        nodes = [(kind == PART, kind == LAST, ids) for kind, ids in leaves]  # (goes on to the right, ends a word, ids)
        # Parts of a word are joined among themselves first, so that a join never sees two words.
        words, run = [], []
        for node in nodes:
            run.append(node)
            if not node[0]:
                words.append(self._tree(run))
                run = []
        return np.concatenate([*words, *(x[2] for x in run), np.zeros(0, np.uint32)])

    def _tree(self, parts: list[tuple[bool, bool, np.ndarray]]) -> np.ndarray:
        while len(parts) > 1:
            pairs = [(a, b) for a, b in zip(parts[::2], parts[1::2], strict=False)]
            up = [(b[0], b[1], self.window(a[2], b[2], b[1])) for a, b in pairs]
            parts = up + parts[2 * len(pairs) :]
        return parts[0][2]

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Decoded texts.  Without a decoder the library puts one space between tokens."""
        if self.whole.decoder is not None:
            parts = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return pa.array(self.whole.decode_batch(parts, skip_special_tokens=False), pa.large_string())
        tokens = pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), self.token_array.take(pa.array(ids)))
        return pc.binary_join(tokens, pa.scalar(" ", pa.large_string()))


def check(spec: dict, path: str) -> None:
    """Refuse files for which a cut at white space, or the window rule, would not be exact."""
    model, pre, norm = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
    splits = [p for p in pre.get("pretokenizers", []) if p["type"] == "Split"]
    steps = [n["type"] for n in norm.get("normalizers", [])]
    ok = model["type"] == "BPE" and not model["dropout"] and not model["ignore_merges"] and not model["byte_fallback"] and not model["continuing_subword_prefix"]
    ok &= [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": PATTERN} and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
    ok &= steps == ["NFC", "Replace", "Lowercase"] and spec["post_processor"] is None
    ok &= not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
    if not ok or not ordered(model["merges"]):
        raise ValueError(f"{path}: texts of this tokenizer can't be cut and joined exactly")


def ordered(merges: list) -> bool:
    """Whether each merge uses only characters and what earlier merges, and no later ones, make."""
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    made = {a + b: n for n, (a, b) in enumerate(pairs)}
    return all(made.get(a, -1) < n and made.get(b, -1) < n for n, (a, b) in enumerate(pairs))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def cut(text: str, leaf_chars: int, split: Callable[[str], list]) -> Iterator[tuple[int, str | int]]:
    """(kind, payload) of the leaves of a long text, in order."""
    at = 0
    while at < len(text):
        end = at + leaf_chars
        if end >= len(text):
            end = len(text)
        else:
            spaces = [m.start() for m in SPACE.finditer(text, max(at + 1, end - 4096), end + 1)] or [m.start() for m in SPACE.finditer(text, at + 1, end + 1)]
            if spaces:
                end = spaces[-1]
            else:  # one run that is longer than a leaf, from here to the next white space
                m = SPACE.search(text, end)
                end = m.start() if m else len(text)
                yield from cut_run(text[at:end], leaf_chars, split)
                at = end
                continue
        yield TEXT, text[at:end]
        at = end


def cut_run(run: str, leaf_chars: int, split: Callable[[str], list]) -> Iterator[tuple[int, str]]:
    """Leaves of a run without white space inside: split words by the leaf, long words by halves."""
    head = SPACE.match(run)
    words, size = [], 0
    for word in split(run[head.end() :] if head else run):
        if isinstance(word, int) or len(word) <= leaf_chars:
            words.append(f"\n{word}" if isinstance(word, int) else word)
            size += len(words[-1])
            if size <= leaf_chars:
                continue
        if words:
            yield WORDS, " ".join(words)
            words, size = [], 0
        if isinstance(word, str) and len(word) > leaf_chars:
            parts = [word]
            while len(parts[0]) > leaf_chars:
                parts = [half for p in parts for half in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
            yield from ((PART, p) for p in parts[:-1])
            yield LAST, parts[-1]
    if words:
        yield WORDS, " ".join(words)


def _short_texts(path: str):
    """(id, content) -> (id, n_tokens, ids, decoded) for texts of one leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids, bounds = bpe.encode(batch.column("content"))
            yield _rows(bpe, batch.column("id"), ids, bounds)

    return run


def _rows(bpe: WordBpe, row_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds * 4, np.int64)), pa.py_buffer(ids.astype("<u4"))])
    return pa.RecordBatch.from_arrays(
        [row_ids, pa.array(np.diff(bounds), pa.int64()), data.cast(pa.binary()), bpe.decoded(ids, bounds).cast(pa.string())],
        names=["id", "n_tokens", "ids", "decoded"],
    )


def _leaves(path: str, leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for n in range(batch.num_rows):
                leaves = list(cut(batch.column("content")[n].as_py(), leaf_chars, bpe.split))
                for at in range(0, len(leaves), 256):
                    some = leaves[at : at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.concat_arrays([batch.column("id").slice(n, 1)] * len(some)),
                            pa.array([batch.column("row")[n].as_py()] * len(some), pa.int64()),
                            pa.array(range(at, at + len(some)), pa.int64()),
                            pa.array([k for k, _ in some], pa.int32()),
                            pa.array([p for _, p in some], pa.string()),
                        ],
                        names=["id", "row", "leaf", "kind", "payload"],
                    )

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            kinds, out = batch.column("kind").to_pylist(), [b""] * batch.num_rows
            texts = [n for n, k in enumerate(kinds) if k == TEXT]
            ids, bounds = bpe.encode(batch.column("payload").take(pa.array(texts, pa.int64())))
            for n, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
                out[n] = ids[a:b].astype("<u4").tobytes()
            for n, (k, payload) in enumerate(zip(kinds, batch.column("payload"), strict=True)):
                if k == WORDS:
                    words = [[int(w[1:])] if w[0] == "\n" else bpe.word(w) for w in payload.as_py().split(" ")]
                    out[n] = np.array([i for w in words for i in w], "<u4").tobytes()
                elif k != TEXT:
                    out[n] = np.array(bpe.part(payload.as_py(), k == LAST), "<u4").tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "row", "leaf", "kind")), pa.array(out, pa.binary())], names=["id", "row", "leaf", "kind", "ids"])

    return run


def _joined(path: str):
    """Leaves sorted by text and place -> a row for each text; one text at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, row, row_id, leaves = load(path), None, None, []

        def text() -> pa.RecordBatch:
            ids = bpe.joined(leaves)
            return _rows(bpe, row_id, ids, np.array([0, len(ids)], np.int64))

        for batch in batches:
            rows, kinds = batch.column("row").to_pylist(), batch.column("kind").to_pylist()
            for n, r in enumerate(rows):
                if r != row:
                    if leaves:
                        yield text()
                    row, row_id, leaves = r, batch.column("id").slice(n, 1), []
                leaves.append((kinds[n], np.frombuffer(batch.column("ids")[n].as_py(), "<u4")))
        if leaves:
            yield text()

    return run


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 16384) -> DataFrame:
    """One row per input row: id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded.

    Ids are those of the library's ``encode`` with ``add_special_tokens=False`` and
    without truncation or padding; strings of special tokens in a text become
    them, as the library does by default.  Null counts as empty, and an empty text
    has no ids and decodes to nothing.  Texts of more than ``leaf_chars`` characters
    go through the tree; a row is never shared, so repeated rows, ties and null ids
    each keep theirs.  Extra columns are ignored; an empty table gives an empty
    result.  A task holds a batch of leaves, or the ids of one text.
    """
    spark = docs.sparkSession
    load(tokenizer_path)
    python_ready(spark, batch_bytes=4 << 20)
    kind = id_type(docs, id_col)
    rows = columns_of(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("content"))
    out = f"id {kind}, n_tokens long, ids binary, decoded string"
    short = rows.where(F.char_length("content") <= leaf_chars).mapInArrow(_short_texts(tokenizer_path), out)
    long = rows.where(F.char_length("content") > leaf_chars).select("id", F.monotonically_increasing_id().alias("row"), "content")
    leaves = long.mapInArrow(_leaves(tokenizer_path, leaf_chars), f"id {kind}, row long, leaf long, kind int, payload string")
    encoded = leaves.repartition("row", "leaf").mapInArrow(_encoded(tokenizer_path), f"id {kind}, row long, leaf long, kind int, ids binary")
    whole = encoded.repartition("row").sortWithinPartitions("row", "leaf").mapInArrow(_joined(tokenizer_path), out)
    return short.unionByName(whole).withColumnRenamed("id", id_col)
