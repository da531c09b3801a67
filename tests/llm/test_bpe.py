"""Tree concatenation against the tokenizers library on whole texts."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from terrafold.llm import bpe
from terrafold.llm.queries import QUERIES, tokenizer

PATH = tokenizer("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
ALPHABETS = ["aaaabcdefghxyz'ss12é<|>Σ中́ß.   \x1c\x85", "aaaabcdefghxyz'ss12é<|>Σ中́ß.\x1c", "ab", "aeiouthn", " éo", "!?."]
ODD = ["", " ", "\n\t ", "x" * 5000, "ab" * 3000, "Hello <|endoftext|> wor<|endoftext|>ld'll don''t", "a" * 300 + "<|startoftext|>" + "b1" * 200, "é" * 700, "é" * 400, " a b", "İSTANBUL ΣΑΣ", "=" * 3000, "7" * 900]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice(rng.choice(ALPHABETS[:2]) if k == 6 else ALPHABETS[k]) for _ in range(rng.choice([5, 60, 900]))) for k in (0, 1, 2, 3, 4, 5, 0, 1) * 12]


@pytest.mark.parametrize("leaf", [7, 16, 333])
def test_leaves_join_to_the_whole(library, leaf):
    model = bpe.load(PATH)
    for text in texts():
        parts = list(bpe.cut(text, leaf, model.split))
        assert all(len(p) <= leaf or k in (bpe.TEXT, bpe.WORDS) for k, p in parts)
        coded = []
        for kind, payload in parts:
            if kind == bpe.TEXT:
                ids = model.encode(pa.array([payload]))[0]
            elif kind == bpe.WORDS:
                ids = np.array([i for w in payload.split(" ") for i in ([int(w[1:])] if w[0] == "\n" else model.word(w))], np.uint32)
            else:
                ids = np.array(model.part(payload, kind == bpe.LAST), np.uint32)
            coded.append((kind, ids))
        assert model.joined(coded).tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_rows_are_those_of_the_library(spark, library):
    rows = list(enumerate([None, "same", "same", *texts()]))
    rows += [(None, "of no id"), (0, "of an id twice"), (900, "word " * 40_000), (901, "ab" * 60_000)]
    docs = spark.createDataFrame([(i, t, "n", 3) for i, t in rows], "doc_id long, text string, ids string, row int")
    for leaf in (50, 16384):
        got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode(docs, PATH, leaf_chars=leaf).collect()), key=str)
        want = []
        for i, t in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
        assert got == sorted(want, key=str)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op13_bpe"](spark, DATA)
    assert [f"{n}:{t}" for n, t in got.dtypes] == ["doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"]
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_files_that_cannot_be_cut_are_refused():
    with pytest.raises(ValueError):
        bpe.WordBpe(tokenizer("byte_bpe_50k.json"))
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert bpe.ordered(spec["model"]["merges"]) and bpe.ordered(["a b", "ab c"]) and not bpe.ordered(["ab c", "a b"])
