"""The text operators against brute force, libraries, planted cases and awkward rows."""

import binascii
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrafold.llm import decontaminate, exact_dedup, html_text, language, lm_score, near_dup, packing, pii, token_counts, toxicity
from terrafold.llm.queries import ORACLE_SQL, QUERIES, tokenizer

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, content string, salt int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [(1, None), (2, ""), (3, "Same Text"), (4, "same text"), (4, "same text"), (None, "same text"), (5, "word " * 30000), (6, "x" * 200000), (7, "9 " * 50000), (8, "\n\t "), (9, "Ä ä")]
    return spark.createDataFrame([(i, t, None, None, None, "d", 5, "c", 3) for i, t in rows], DOCS)


def crc(i, m):
    return binascii.crc32(str(i).encode()) % m


def test_ops_take_awkward_and_empty_tables(spark, tmp_path):
    odd, labels = awkward(spark), spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "nine " * 40)], "item_id long, text string")
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>a"), (2, "u", "<div" * 2000), (3, "u", "<div>" * 3000 + "x")], "page_id long, url string, html string")
    ops = {
        "1": lambda d: decontaminate.overlaps(d, bench),
        "2": lambda d: token_counts.count_tokens(d, tokenizer("piece_bpe_32k.model"), str(tmp_path / "cache")),
        "4": exact_dedup.exact_dedup,
        "5": pii.find,
        "6": lambda d: packing.pack(d, tokenizer("byte_bpe_50k.json")),
        "7": language.identify,
        "8": near_dup.classes,
        "9": lambda d: toxicity.score(d, labels),
    }
    for name, op in ops.items():
        assert op(odd.limit(0)).count() == 0, name
        n = op(odd).count()
        assert name in "16" or n == odd.count(), name
    assert html_text.extract(pages).count() == 4 and html_text.extract(pages.limit(0)).count() == 0


def test_lm_scores_awkward_and_empty_tables(spark):
    ranks = tokenizer("byte_bpe_50k.tiktoken")
    odd = awkward(spark)
    assert lm_score.score(odd.limit(0), ranks).count() == 0
    rows = lm_score.score(odd, ranks).collect()
    assert len(rows) == 11 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)


def test_exact_dedup_matches_groups(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r.text)].append(r.doc_id)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in exact_dedup.exact_dedup(docs).collect()} == want
    # With a digest of one character, groups collide and are told apart by content.
    short = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1)).collect()}
    assert short == {w[:4] for w in want}


def test_exact_dedup_keeps_other_texts_of_an_id(spark):
    rows = [(5, "a"), (9, "A"), (5, "b"), (None, "a"), (7, None), (8, ""), (9, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"broadcast_rows": 0}):
        got = [tuple(r) for r in exact_dedup.keep_one(docs, **how).collect()]
        assert sorted(got, key=str) == sorted([(9, "A"), (9, "a"), (5, "b"), (None, "a"), (8, "")], key=str)


def test_decontamination_tolerates_substitutions(spark):
    item = [f"w{i}" for i in range(30)]
    swapped = [("other" if i % 7 == 3 else w) for i, w in enumerate(item)]
    loose = [("other" if i % 2 else w) for i, w in enumerate(item)]
    filler = " ".join(f"f{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"{filler} {' '.join(item)}. {filler}"), (2, f"{filler} {' '.join(swapped)}"), (3, f"{filler} {' '.join(loose)}"), (4, filler), (5, "only five short words here"), (6, f"{' '.join(item[:20])} {filler}")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item).upper()), (11, "five short words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.doc_start) for r in decontaminate.overlaps(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 10), (5, 11)}
    assert got[1, 10] == (30, 50)
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {3, 4}
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench, block_seeds=20).collect()} == set(got)


def test_decontamination_tests_every_stretch(spark):
    rng = np.random.default_rng(8)
    patterns = [[i not in (1, 14) for i in range(16)], [True] * 13 + [False] * 6 + [True] * 12 + [False] * 6]
    for n, gone in ((14, 1), (15, 2), (16, 2), (16, 3), (18, 3), (20, 4), (37, 8), (59, 15), (59, 30)):
        patterns += [[bool(x) for x in ~np.isin(np.arange(n), rng.choice(n, gone, replace=False))] for _ in range(20)]
    patterns += [[False] * 5, [True], [False, True, False]]

    def best(hits):  # brute force over all stretches
        some = [(sum(hits[a:b]), a - b) for a in range(len(hits)) for b in range(a + 1, len(hits) + 1) if hits[a] and hits[b - 1] and 5 * sum(hits[a:b]) >= 4 * (b - a)]
        return max(some, default=None)

    rows = spark.createDataFrame(list(enumerate(patterns)), "n int, hits array<boolean>").select("n", decontaminate._best_stretch(F.col("hits"), 0.8).alias("b"))
    got = {r.n: r.b and (r.b.hit, -r.b.length) for r in rows.collect()}
    assert got == {n: best(hits) for n, hits in enumerate(patterns)}
    # Through the seeds: each passage that one of them hits and that meets the rule is reported.
    seeded = lambda hits: any(all(c == "0" or hits[a + i] for i, c in enumerate(m)) for m in decontaminate.MASKS for a in range(len(hits) - len(m) + 1))
    docs = spark.createDataFrame([(n, " ".join(f"w{n}x{i}" if hit else "other" for i, hit in enumerate(hits))) for n, hits in enumerate(patterns)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(f"w{n}x{i}" for i in range(len(hits)))) for n, hits in enumerate(patterns)], "item_id long, text string")
    want = {n for n, hits in enumerate(patterns) if len(hits) >= 13 and seeded(hits) and (best(hits) or (0,))[0] >= 13}
    assert {0, 1} <= want
    assert {r.doc_id for r in decontaminate.overlaps(docs, bench).collect() if len(patterns[r.doc_id]) >= 13} == want


def test_decontamination_finds_whole_items(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    tokens = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = {r.item_id: f" {tokens(r.text)} " for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in f" {tokens(r.text or '')} "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert want <= got


def test_decontamination_of_long_items_and_many_hits(spark):
    rng = np.random.default_rng(3)
    item = [f"w{x}" for x in rng.integers(0, 3000, 6000)]
    changed = [("other" if i % 9 == 4 else w) for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, "x " * 500), (3, " ".join(item[1000:1040])), (3, "short"), (None, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (7, "x y z")], "item_id long, text string")
    for how in ({}, {"block_seeds": 5000}, {"broadcast_rows": 0}):
        got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(docs, bench, **how).collect()}
        assert got == {(1, 7): sum(a == b for a, b in zip(item, changed, strict=True)), (3, 7): 40}


def test_decontamination_matches_brute_force(spark):
    """Every alignment that a seed hits and that meets the rule, and no other, on the whole of a small table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r.item_id: tokens(r.text) for r in bench.collect()}
    index = defaultdict(set)
    for i, words in items.items():
        for m in decontaminate.MASKS:
            for at in range(len(words) - len(m) + 1):
                index[m, tuple(words[at + k] for k, c in enumerate(m) if c == "1")].add((i, at))
    want = set()
    for r in docs.collect():
        words, seen = tokens(r.text or ""), set()
        for m in decontaminate.MASKS:
            for at in range(len(words) - len(m) + 1):
                seen |= {(i, at - place) for i, place in index.get((m, tuple(words[at + k] for k, c in enumerate(m) if c == "1")), ())}
        for i, shift in seen:
            hits = [0 <= k + shift < len(words) and words[k + shift] == w for k, w in enumerate(items[i])]
            sums = np.concatenate([[0], np.cumsum(hits)])
            if any(sums[b] - sums[a] >= min(13, len(hits)) and 5 * (sums[b] - sums[a]) >= 4 * (b - a) for a in range(len(hits)) for b in range(a + 1, len(hits) + 1)):
                want.add((r.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()} == want and want


def test_token_counts_and_cache(spark, docs, tmp_path):
    import sentencepiece

    path, cache = tokenizer("piece_bpe_32k.model"), str(tmp_path / "cache")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs, path, cache).collect()}
    for r in docs.collect():
        t = r.text or ""
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].n_bytes) == (len(model.encode(t)), len(t.encode()))
        assert rows[r.doc_id].over_limit == (rows[r.doc_id].n_tokens > 4096)
    stored = spark.read.parquet(cache).count()
    assert stored == docs.select("text").distinct().count()
    token_counts.count_tokens(docs, path, cache).count()
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded again
    special = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert token_counts.count_tokens(special, tokenizer("byte_bpe_50k.json"), cache).first().n_tokens == 4


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json"), rank_rows=7).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(ids)
    for i, parts in pieces.items():
        at = 0
        for n, (piece, start, length, check) in enumerate(sorted(parts)):
            assert (piece, start) == (n, at) and check == binascii.crc32(np.array(ids[i][at : at + length], "<u4").tobytes())
            assert len(parts) == 1 or n == 0 or length == 2048
            at += length
        assert at == len(ids[i]) and (len(parts) == 1) == (at <= 2048)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(map(len, ids.values())) / 2048) + 1


def test_packing_ids_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["x <|endoftext|> y  z", "plain  text\n\n é", " " * 1_000_000, "\n" * 300_000 + "a", " \t" * 2000 + "b", "\u2003" * 100_000, "a" * 100_000, "don't I'LL 12ab\u00b2", "\u200b\u0301 中文 😀"]
    plain = [c for c in map(chr, range(0x2100)) if not packing.UNSURE.search(c)]
    assert len(plain) > 500
    for c in plain:  # each plain character between letters, digits, spaces, signs and itself
        texts.append("".join(f"a{c}b {c} 1{c}2 {c}x{c}{c}\n{c}.{c},  {c}{c} {other}{c}" for other in "é'½"))
    assert packing._encoder(path)(texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame([("one", " " * 1_000_000), ("two", None)], "doc_id string, text string")
    rows = packing.pack(docs, path).collect()
    assert sum(r.length for r in rows if r.doc_id == "one") == len(tok.encode(" " * 1_000_000).ids) + 1 and sum(r.doc_id == "two" for r in rows) == 1


@pytest.mark.parametrize("capacity", [10, 100, 2048])
def test_packing_plan(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(30):
        counts = Counter(int(x) for x in np.minimum(capacity, 1 + rng.exponential(capacity / rng.integers(2, 12), rng.integers(0, 500))))
        bins, seen = defaultdict(list), Counter()
        for length, first, n, sequence, each, offset in packing.plan_runs(dict(counts), capacity).tolist():
            assert first == seen[length]
            seen[length] += n
            for i in range(n):
                bins[sequence + i // each].append((offset + i % each * length, length))
        assert seen == counts
        for parts in bins.values():
            ends = np.cumsum([x[1] for x in sorted(parts)])
            assert ends[-1] <= capacity and [x[0] for x in sorted(parts)] == [0, *ends[:-1].tolist()]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    ok = {
        "email": lambda m, d: True,
        "ip": lambda m, d: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m, d: 14 <= len(d) <= 19 and luhn(d),
        "phone": lambda m, d: 10 <= len(d) <= 15,
    }
    found = [(m.start(), i, m.end()) for i, k in enumerate(BASE) for m in re.finditer(BASE[k], text) if ok[k](m[0], re.sub("[^0-9]", "", m[0]))]
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_pii_base_and_added_spans(spark, docs):
    extra = ["a@b.c..x@y.z", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0255", "😀 a@b.co +1 (555) 123-4567", "1 " * 30000, "a." * 20000 + "@b" + ".c" * 20000, "4111 1111 1111 1111"]
    extra.append("write to anna [at] example dot com, call (555) 123-4567, card 4111.1111.1111.1111")
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.find(rows).collect()}
    for r in rows.collect():
        want = base_spans(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[r.doc_id].spans.split(",")) | {""}
        assert [getattr(got[r.doc_id], f"n_{k}") for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
    assert got[10**6 + 7].n_added == 3
    assert sum(r.n_added for i, r in got.items() if i < 10**6) <= 2


def test_pii_many_matches_in_a_text(spark):
    texts = [" ".join(f"user{i}@mail.example" for i in range(6000)), "1.2.3.4 " * 500, "a" * 300, None]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest()
    numbers = spark.createDataFrame([([],), ([5],), (list(range(300)),)], "n array<int>").select("n", pii._sums_before(F.col("n"), 7).alias("s")).collect()
    assert all(r.s == [sum(r.n[:i]) for i in range(len(r.n))] for r in numbers)


def test_pii_added_spans_in_running_text(spark, docs):
    """Unseen proposals put into the corpus's own prose: the personal ones are found, the others left alone."""
    trees = pii.fitted(spark)
    made = [r for r in pii.sample_spans(spark, 1520, first=10**6).collect() if r.kind != "card" or r.label in (0, 1)]
    prose = [" ".join(re.findall(r"[^\W\d_]+", r.text))[:400] for r in docs.where("text IS NOT NULL").orderBy("doc_id").limit(40).collect()]
    prose = [p for p in prose if len(p) > 100]
    texts = [(i, f"{prose[i % len(prose)]} {r.before}", r.s, f"{r.after} {prose[(i + 7) % len(prose)]}") for i, r in enumerate(made)]
    rows = spark.createDataFrame([(i, a + s + z) for i, a, s, z in texts], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(rows).collect()}
    hit = total = false = clean = 0
    for (i, a, s, _), r in zip(texts, made, strict=True):
        spans = [x.split(":") for x in found[i].spans.split(",") if x]
        there = any(k == r.kind and int(b) < len(a) + len(s) and len(a) < int(e) for k, b, e in spans)
        if r.label == 1:
            total, hit = total + 1, hit + there
        else:
            clean, false = clean + 1, false + there
    assert trees.thresholds.keys() == set(pii.KINDS) and total > 300 and hit / total >= 0.85 and hit / (hit + false) >= 0.95


def test_html_keeps_formulas_and_linked_blocks():
    w = html_text.classifier()
    story = "".join(f"<p>Paragraph {i} of the story has some more words in it, as one does.</p>" for i in range(4))
    page = f"<body><nav><a href=/>Home</a> <a href=/x>News</a></nav><article><h1>Title</h1>{story}<p>The area is <math><mi>a</mi><mo>=</mo><msup><mi>r</mi><mn>2</mn></msup></math> in total, they said.</p></article><footer>Imprint</footer></body>"
    text = html_text.main_text(page, w)
    assert "The area is a=r2 in total, they said." in text and "Home" not in text and "Imprint" not in text
    linked = html_text.blocks_of("<a href=x><div>One two</div><div>three</div></a><div>four</div><section><a href=y>five<p>six</section><p>seven</p>")
    assert [(b.text(), b.linked > 0) for b in linked] == [("One two", True), ("three", True), ("four", False), ("five", True), ("six", True), ("seven", False)]
    long = "When the council met again in the autumn, it heard from many of those who live by the river, and it decided to wait until the water had gone down. " * 3
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{story}<div class='share-header'><p>{long}</p></div>{story}</article></body>"
    assert long.strip() in html_text.main_text(page, w)


@pytest.mark.parametrize(
    "page",
    [
        "<div id=wrap><div class=topbar><a href=/>Start</a> <a href=/a>A</a></div><table><tr><td class=menu><a href=1>One</a><br><a href=2>Two</a></td><td class=content>{}</td></tr></table><div class=footer>All rights reserved</div></div>",
        "<header><nav><ul><li><a href=/>Start</a></ul></nav></header><main>{}<section class=comments><h2>Comments</h2><div class=comment><p>All rights reserved, I think.</p></div></section></main>",
        "<body><div role=banner><a href=/>Start</a></div>{}<aside><h3>More</h3><ul><li><a href=r>All rights reserved</a></li></ul></aside><form><p>Start your search</p><input></form></body>",
    ],
)
def test_html_layouts(page):
    said = ["The first paragraph tells what happened on the market square last night.", "A second one, with &quot;words&quot; that somebody said, goes on for a while.", "And the last paragraph says how it all came to an end."]
    text = html_text.main_text(page.format("".join(f"<p>{p}</p>" for p in said)), html_text.classifier())
    assert text.split("\n") == [p.replace("&quot;", '"') for p in said]


def test_html_of_very_many_blocks():
    page = "<div>" + "<p>Some words of a story that does not end.</p><div class=menu><a href=x>go</a></div>" * 8000 + "</div>"
    text = html_text.main_text(page, html_text.classifier())
    assert text.count("Some words") == 8000 and "go" not in text.split()


def test_html_text():
    w = html_text.classifier()
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=x>One</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><main><article><h1>A &amp; B</h1><p>First   part<b>ly</b> bold.<br>More &copy; text&nbsp;here.</p><div class="ad">Buy now.</div><p>Second paragraph of the story.</article>
    <section id="comments"><div class="comment"><p>I liked this article very much, thanks.</p></div></section></main><aside><p>Related things to read.</p></aside><form><label>Mail</label></form><footer>&copy; us</footer>"""
    assert html_text.main_text(page, w) == "A & B\nFirst partly bold. More © text here.\nSecond paragraph of the story."
    assert html_text.main_text("", w) == "" and html_text.main_text("<nav><a>x</a></nav>", w) == ""
    good = total = 0
    for page, kept in html_text.sample_pages(60, seed=77):
        got = {line.split()[0].rstrip(".") for line in html_text.main_text(page, w).split("\n") if line}
        good, total = good + len(got & kept), total + len(got | kept)
    assert good / total > 0.97


def test_min_cut_is_least():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        a, b = rng.random(n).tolist(), rng.random(n).tolist()
        edges = [(int(i), int(j), float(w)) for i, j, w in zip(rng.integers(0, n, 10), rng.integers(0, n, 10), rng.random(10) * 0.5, strict=True) if i != j]
        cost = lambda keep: sum(a[i] if keep[i] else b[i] for i in range(n)) + sum(w for i, j, w in edges if keep[i] != keep[j])  # noqa: E731,B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_text.min_cut(a, b, edges)) - best) < 1e-9


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs, train_rows=400).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    none = spark.createDataFrame([(1, None, "en"), (2, "12 34!", "de"), (3, "½ ² ① Ⅷ _", "de"), (4, "", None)], "doc_id long, text string, lang string")
    assert {tuple(r)[2:] for r in language.identify(none).collect()} == {("und", 0.0)}


def test_language_words_are_letters():
    assert language.words_of("½ ² ① Ⅷ _ 12") == [] and language.words_of("Aujourd'hui x²y 'tis l’été") == ["aujourd'hui", "x", "y", "tis", "l’été"]


def test_language_labels_code_switched_words(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND length(text) > 400").orderBy("doc_id").collect()
    train, test = [r for r in rows if r.doc_id % 4], [r for r in rows if r.doc_id % 4 == 0]
    model = language.train([r.text for r in train], [r.lang for r in train])
    right = total = 0
    for a, b in zip(test, test[1:], strict=False):
        if a.lang != b.lang:
            parts = [language.words_of(a.text)[:30], language.words_of(b.text)[:30], language.words_of(a.text)[30:45]]
            words, marginals, _ = model.label([" ".join(w for p in parts for w in p)])
            truth = [a.lang] * len(parts[0]) + [b.lang] * len(parts[1]) + [a.lang] * len(parts[2])
            right += sum(model.labels[k] == t for k, t in zip(marginals.argmax(axis=1), truth, strict=True))
            total += len(words[0])
    assert total > 2000 and right / total > 0.9


def test_language_gradient():
    rng = np.random.default_rng(4)
    model = language.Model(["a", "b", "c"], np.zeros((1 << language.BITS, 3)), rng.standard_normal((3, 3)))
    distinct = ["x", "yy", "zzz"]
    codes, bounds, y = rng.integers(0, 3, 9), np.array([0, 5, 6, 9]), rng.integers(0, 3, 9)
    emissions = rng.standard_normal((3, 3))
    model.emissions = lambda words: emissions

    def loss():
        total = 0.0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            paths = [emissions[codes[a:b], s].sum() + sum(model.transitions[i, j] for i, j in zip(s, s[1:], strict=False)) for s in np.stack(np.meshgrid(*[range(3)] * (b - a), indexing="ij"), -1).reshape(-1, b - a)]
            own = y[a:b]
            total += np.log(np.exp(paths).sum()) - emissions[codes[a:b], own].sum() - sum(model.transitions[i, j] for i, j in zip(own, own[1:], strict=False))
        return total

    by_word, pairs = language.gradient(model, codes, bounds, distinct, y)
    for table, g in ((emissions, by_word), (model.transitions, pairs)):
        for at in np.ndindex(3, 3):
            table[at] += 1e-5
            up = loss()
            table[at] -= 2e-5
            assert (up - loss()) / 2e-5 == pytest.approx(g[at], abs=1e-6)
            table[at] += 1e-5


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b"], np.zeros((1, 2), np.float32), rng.standard_normal((2, 2)).astype(np.float32))
    e = rng.standard_normal((5, 2)).astype(np.float32)
    got = model.marginals(e, np.array([0, 3]), np.array([3, 2]))
    for start, n in ((0, 3), (3, 2)):
        weight = np.zeros((n, 2))
        for m in range(1 << n):
            y = [m >> i & 1 for i in range(n)]
            w = np.exp(sum(e[start + i, y[i]] for i in range(n)) + sum(model.transitions[y[i], y[i + 1]] for i in range(n - 1)))
            for i in range(n):
                weight[i, y[i]] += w
        assert np.allclose(got[start : start + n], weight / weight.sum(axis=1, keepdims=True), atol=1e-5)


def edits(a, b):
    """Edit distance by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def classes_by_force(texts, threshold=0.8):
    """Smallest index of the component of each text, by the edit distance of all pairs that have enough words in common."""
    words = [t.lower().split() for t in texts]
    bags, root = [Counter(w) for w in words], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            limit = (1 - threshold) * longer + 1e-9
            if abs(len(words[i]) - len(words[j])) > limit or top(i) == top(j):
                continue
            if longer - sum((bags[i] & bags[j]).values()) <= limit and edits(words[i], words[j]) <= limit:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def near_classes(spark, texts, **how):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    return [got[i] for i in range(len(texts))]


def test_near_duplicates(spark):
    rng = np.random.default_rng(0)
    base = [f"w{x}" for x in rng.integers(0, 400, 300)]
    few, many = list(base), list(base)
    for i in range(0, 300, 12):
        few[i] = "changed"
    for i in range(0, 300, 4):
        many[i] = f"new{i}"
    rows = [(1, " ".join(base)), (2, " ".join(few)), (3, " ".join(many)), (4, " ".join(base).upper()), (5, "a b c"), (6, "a b c d"), (7, None), (8, ""), (9, " ".join(base[::-1]))]
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, 3, True) and got[2] == (1, 3, False) and got[4] == (1, 3, False)
    assert got[3][0] == 3 and got[5][0] == 5 and got[6][0] == 6 and got[9][0] == 9 and got[7][0] == got[8][0] == 7


def test_near_duplicates_among_short_texts(spark):
    rng = np.random.default_rng(6)
    texts = []
    for group in range(40):
        words = [f"g{group}x{x}" for x in range(rng.integers(4, 48))]
        swapped = [f"o{x}" if x % 6 == 2 else w for x, w in enumerate(words)]
        texts += [words, words[:-1], words[1:], words[: len(words) // 2], [*words, "more"], [*words[:-1], "other"], swapped]
    common = [f"c{x}" for x in range(7)]  # a run that many texts begin with
    texts += [[*common, *(f"t{n}x{x}" for x in range(n % 6))] for n in range(60)]
    texts = [" ".join(t) for t in texts]
    want = classes_by_force(texts)
    assert near_classes(spark, texts) == want
    assert near_classes(spark, texts, block=2) == want
    nine = "one two three four five six seven eight nine"
    assert near_classes(spark, [nine, nine.rsplit(" ", 1)[0]]) == [0, 0]


def test_pairs_of_several_mixed_buckets_are_compared_in_the_first():
    """Ten texts that are alike, all in bucket 7; some pairs share bucket 3 or 5 as well, one shares a later one."""
    words = [" ".join(f"w{i}" for i in range(80)) + f" own{n}" for n in range(10)]
    codes = [near_dup.codes_of(t).astype(np.uint32).view(np.int32).tolist() for t in words]
    bands = [[7], [7, 3], [7, 3, 9], [5, 7], [9, 7], [7, 5, 3], [7], [3, 7], [7, 5], [7, 9]]

    def table(rows, **more):
        columns = {"band": [7] * len(rows), "id": rows, "root": rows, "all_bands": [bands[r] for r in rows], "codes": [codes[r] for r in rows]}
        types = {"all_bands": pa.list_(pa.int64()), "codes": pa.list_(pa.int32())}
        return pa.table({n: pa.array(v, types.get(n, pa.int64())) for n, v in (columns | more).items()})

    run = near_dup._block_links(5, 0.8)
    asking = list(range(1, 10))
    got = run(table(list(range(10))), table(asking, major=[0] * len(asking)))
    linked = {(min(p), max(p)) for p in zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)}
    assert linked == {(a, b) for a in range(10) for b in range(a + 1, 10) if not {x for x in bands[a] if x < 7} & set(bands[b])}
    assert len(linked) < 45


def test_near_duplicates_in_mixed_buckets(spark):
    rng = np.random.default_rng(9)
    passage = [f"p{x}" for x in range(80)]
    texts = []
    for group in range(30):  # all share a passage that makes up most of them; some are copies with edits, too
        own = [f"g{group}x{x}" for x in rng.integers(0, 90, 60)]
        for copy in range(1 + group % 4):
            words = [f"e{rng.integers(10**6)}" if rng.random() < 0.06 else w for w in own]
            texts.append(" ".join(passage + words if copy % 2 else words[:30] + passage + words[30:]))
    want = classes_by_force(texts)
    assert len(set(want)) > 25 and near_classes(spark, texts) == want and near_classes(spark, texts, block=3) == want


def test_near_duplicates_lose_and_invent_no_link(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    texts = [t for t in texts if len(t.split()) <= 700][:600]
    assert near_classes(spark, texts) == classes_by_force(texts)


def test_near_duplicates_are_caught(spark):
    """Planted copies with 8 % of the words changed, left out or put in, against a corpus of others."""
    rng = np.random.default_rng(12)
    texts, want = [], []
    for group in range(150):
        words = [f"w{x}" for x in rng.zipf(1.2, rng.integers(50, 400)) % 5000]
        for copy in range(2):
            out = []
            for w in words:
                kind = rng.random() if copy else 1.0
                out += [[f"n{rng.integers(999)}"], [], [w, "put"], [w]][0 if kind < 0.03 else 1 if kind < 0.055 else 2 if kind < 0.08 else 3]
            texts.append(" ".join(out))
            want.append(2 * group)
    got = near_classes(spark, texts)
    assert np.mean([g == w for g, w in zip(got[1::2], want[1::2], strict=True)]) >= 0.98
    assert all(g in (w, w + 1) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("share", [0.10, 0.14, 0.18, 0.195])
def test_near_duplicates_are_caught_up_to_the_limit(spark, share):
    """Pairs of long texts with so many of the words changed, each in a place of its own; the rule's limit is 0.2."""
    rng = np.random.default_rng(int(1000 * share))
    texts = []
    for group in range(100):
        words = [f"w{group}x{x}" for x in rng.integers(0, 400, int(rng.choice([60, 150, 300, 900])))]
        other = list(words)
        for i in rng.choice(len(words), int(share * len(words)), replace=False):
            other[i] = f"n{group}x{i}"
        texts += [" ".join(words), " ".join(other)]
    got = near_classes(spark, texts)
    assert np.mean([got[2 * g + 1] == 2 * g for g in range(100)]) >= 0.9
    assert all(got[i] // 2 == i // 2 for i in range(200))


def test_near_duplicate_links_unite_alike_in_a_task_and_by_joins(spark):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 60, rng.integers(8, 120))]
        for _ in range(4):
            texts.append(" ".join(f"x{rng.integers(99)}" if rng.random() < 0.08 else w for w in words))
    assert near_classes(spark, texts) == near_classes(spark, texts, one_task=0)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 90, (70, 2))], "a long, b long")
    united = {tuple(r) for r in links.where("a <> b").coalesce(1).mapInArrow(near_dup._united, "id long, root long").collect()}
    assert united == {tuple(r) for r in near_dup.components(links).collect()}


def test_alignment_decides_as_the_edit_distance():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = rng.integers(0, 6 if rng.random() < 0.3 else 99, rng.integers(0, 40)).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 9)):
            at = int(rng.integers(0, len(b) + 1))
            b = [np.delete(b, at) if at < len(b) else b, np.insert(b, at, 7), np.concatenate([b[at:], b[:at]])][rng.integers(0, 3 if rng.random() < 0.1 else 2)]
        true, longer = edits(a.tolist(), b.tolist()), max(len(a), len(b))
        for limit in (0, 2, 5, 40):
            assert near_dup.distance(a, b, limit) == min(true, limit + 1)
        x, y = near_dup.Text(a, 5), near_dup.Text(b, 5)
        assert near_dup.chained(x, y, 40) >= true
        assert near_dup.alike(x, y, 0.8) == near_dup.alike(y, x, 0.8) == (true <= 0.2 * longer + 1e-9)


def test_alignment_of_many_decides_as_of_one():
    rng = np.random.default_rng(11)
    for _ in range(60):
        a = rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64)
        others = [rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64) for _ in range(4)]
        others += [np.delete(a, rng.integers(0, max(1, len(a)), n)) if len(a) else a for n in (0, 1, 5)]
        limits = rng.integers(0, 12, len(others))
        assert near_dup.within(a, others, limits).tolist() == [near_dup.distance(a, b, int(n)) <= n for b, n in zip(others, limits, strict=True)]


def test_alignment_is_spared_where_few_pairs_of_words_are_common(monkeypatch):
    """The same words in another order: as many in common as there are, but no alignment is tried; one within the rule is."""
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in range(200)]
    text = lambda ws: near_dup.Text(near_dup.codes_of(" ".join(ws)), 5)
    other = [f"n{i}" if i % 6 == 2 else w for i, w in enumerate(words)]
    tried = []
    real = near_dup.chained
    monkeypatch.setattr(near_dup, "chained", lambda *a: tried.append(1) or real(*a))
    assert not near_dup.alike(text(words), text(rng.permutation(words)), 0.8) and not tried
    assert near_dup.alike(text(words), text(other), 0.8) and tried


def test_chain_is_longest():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.permutation(12)[:9].astype(np.uint64), rng.permutation(12)[:9].astype(np.uint64)
        best = np.zeros((10, 10), int)
        for i in range(9):
            for j in range(9):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (a[i] == b[j]))
        i, j = near_dup.chain(a, b, 99)
        assert len(i) == best[9, 9] and (a[i] == b[j]).all() and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    for lang in ("en", "de", "fr", "es"):
        bad = [r for r in rows if r.toxic == 1 and r.lang == lang]
        assert sum(r.predicted for r in bad) / len(bad) >= 0.85, lang
    called = [r for r in rows if r.predicted == 1]
    assert sum(r.toxic for r in called) / len(called) >= 0.85


def test_subsequence_kernel_matches_counting():
    words, marks = ["idiot", "idxiot", "i__d__i__o__t", "the", "a"], ["idiot", "moron"]
    weighed = defaultdict(lambda: defaultdict(float))
    for w in {*words, *marks}:
        chars = f"^{w}$"
        for gaps in toxicity.GAPS:
            for at in range(len(chars) - sum(gaps)):
                places = np.cumsum([at, *gaps])
                weighed[w][len(gaps), "".join(chars[p] for p in places)] += toxicity.DECAY ** (sum(gaps) - len(gaps))
    norm = lambda w: math.sqrt(max(1.0, sum(toxicity.DECAY ** (2 * (sum(g) - len(g))) * max(0, len(w) + 2 - sum(g)) for g in toxicity.GAPS)))
    got = toxicity.kernel(words, marks)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert got[i, j] == pytest.approx(sum(x * weighed[m][s] for s, x in weighed[w].items()) / norm(w) / norm(m), abs=1e-4)
    assert got[1, 0] > 0.3 > got[3, 0] and got[2, 0] > got[3, 0]
    weights = np.zeros(1 << toxicity.BITS)
    for owner, feature, weight in toxicity._subsequences(["idiot"]):
        np.add.at(weights, feature, weight / toxicity._norms(["idiot"])[owner])
    assert np.allclose(toxicity.word_margins(["idxiot", "moron"], weights), toxicity.kernel(["idxiot", "moron"], ["idiot"])[:, 0], atol=1e-6)


def test_toxicity_finds_gapped_insults():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("bdfgklmnprst")) + rng.choice(list("aeiou")) for _ in range(rng.integers(1, 4)))
    texts, labels = [], []
    for i in range(600):
        sentences = [" ".join(word() for _ in range(rng.integers(4, 12))) for _ in range(5)]
        labels.append(int(i % 6 == 0))
        if labels[-1]:
            sentences[rng.integers(0, 5)] += " " + rng.choice(["zwickel", "quaddle", "xerfuzz"])
        texts.append(". ".join(sentences) + ".")
    model = toxicity.train(texts, labels, (5 / 6, 1 / 6))
    clean = " ".join(word() for _ in range(40))
    forms = ["zwickel", "Zwickel!", "z w i c k e l", "z.w.i.c.k.e.l", "z__w__i__c__k__e__l", "zwicxkel", "quad-dle", "xerrfuzz"]
    scores = model.scores([*(f"{clean}. and so {f} it is" for f in forms), clean, ""])
    assert (scores[:-2] >= 0.3).all() and (scores[-2:] < 0.3).all()


def test_toxicity_windows_cover_whole_runs():
    spaced = " ".join(chr(97 + i % 7) for i in range(40))
    for text in (f"{spaced} i d i o t", f"i d i o t {spaced}", f"{spaced} i d i o t {spaced}"):
        assert any("idiot" in w and len(w) <= toxicity.SPACED for w in toxicity.windows_of(text))
    for n in (31, 32, 33, 47, 48, 49, 64, 65, 200):  # every stretch of half a window is in a window
        run = "".join(chr(0x61 + i % 26) + chr(0x4E00 + i) for i in range(n))
        for text, size, most in ((run, 16, toxicity.LONGEST), (run[:5] + "-" + run[5:], 16, toxicity.LONGEST), (" ".join(run), 9, toxicity.SPACED)):
            seen = [w for w in toxicity.windows_of(text) if len(w) <= most]
            assert all(any(run[a : a + size] in w for w in seen) for a in range(len(run) - size + 1))


def test_toxicity_finds_insults_after_many_spaced_letters():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("bdfgklmnprst")) + rng.choice(list("aeou")) for _ in range(rng.integers(1, 4)))
    texts, labels = [], []
    for i in range(600):
        texts.append(" ".join(word() for _ in range(30)) + (" " + str(rng.choice(["idiot", "zwickel"])) if i % 6 == 0 else "") + ".")
        labels.append(int(i % 6 == 0))
    model = toxicity.train(texts, labels, (5 / 6, 1 / 6))
    spaced = " ".join("bdfgklmnp"[i % 9] for i in range(40))
    assert (model.scores([f"{spaced} i d i o t", f"{spaced} z w i c k e l {spaced}"]) >= 0.3).all()
    assert model.scores([f"{spaced} {spaced}"])[0] < 0.3


def test_toxicity_of_twice_labelled_rows(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    both = labels.unionByName(labels.where("toxic = 1").withColumn("toxic", F.lit(0).cast(labels.schema["toxic"].dataType)))
    one, two = (toxicity.score(docs, x.repartition(3)).orderBy("doc_id").collect() for x in (labels, both))
    assert one == two


def test_lm_base_and_model(spark, docs):
    rows = {r.doc_id: r for r in lm_score.score(docs, tokenizer("byte_bpe_50k.tiktoken"), frequent_words=50).collect()}
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    counts = Counter(w for i, ws in texts.items() if crc(i, 5) != 1 for w in ws)
    total, below = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    for i, ws in texts.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 5) == 1, len(ws), sum(w in counts for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / below) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def lm_scores(sequences, model):
    return lm_score.log10_probabilities(np.concatenate(sequences), np.array([len(x) for x in sequences]), model, at_once=3, together=2)


def test_lm_windows_score_each_id_once_and_add_to_one():
    rng = np.random.default_rng(0)
    size = 300
    vocab = lm_score.Vocabulary(np.maximum(0, rng.integers(-20, 50, size + 1)).astype(float))
    model = lm_score.Attention(vocab)
    model.p["u"] *= 20
    for n in (1, 23, 24, 25, 100):
        ids = rng.integers(0, size, n)
        rows, target, real, owners = lm_score.windows(np.append(ids, ids[:1]), np.array([n, 1]), vocab)
        assert real.sum() == n + 1 and target[owners == 0][real[owners == 0]].tolist() == vocab.place[ids].tolist()
        assert lm_scores([ids[::-1], ids], model)[1] == pytest.approx(lm_scores([ids], model)[0])
    for n in (0, 5, 30):
        head = rng.integers(0, size, n)
        every = lm_scores([np.append(head, x) for x in range(size + 1)], model)
        before = lm_scores([head], model)[0] if n else 0.0
        assert abs((10 ** (every - before)).sum() - 1) < 1e-3
    plain = lm_scores([head], model)
    model.p["qkv"][:, : 2 * lm_score.KEY] *= 100  # attention weights that overflow are taken against the largest
    assert np.isfinite(lm_scores([head], model)).all() and lm_scores([head], model) != plain


def test_lm_gradient_of_logits_that_overflow():
    """Outputs far from each other are taken against the largest: the gradient is finite, and that of twice the precision."""
    rng = np.random.default_rng(6)
    vocab = lm_score.Vocabulary(np.maximum(0, rng.integers(-20, 50, 400)).astype(float))
    model = lm_score.Attention(vocab)
    for name in ("u", "u0"):
        model.p[name] *= 3000
    rows, target = rng.integers(0, vocab.seen + 3, (3, lm_score.WINDOW)), rng.integers(0, vocab.seen, (3, lm_score.STRIDE))
    real = rng.random(target.shape) < 0.9
    z = model.hidden(rows)
    with np.errstate(over="ignore"):
        assert not np.isfinite(np.exp(z @ model.p["u"])).all()
    short = model.gradient(rows, target, real)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    for name, value in model.gradient(rows, target, real).items():
        assert np.isfinite(short[name]).all() and np.abs(short[name] - value).max() <= 1e-2 * max(1e-3, np.abs(value).max()), name


def test_lm_gradient(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(lm_score, "FIRST", 8)
    vocab = lm_score.Vocabulary(np.maximum(0, rng.integers(-20, 50, 60)).astype(float))
    model = lm_score.Attention(vocab)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rows, target = rng.integers(0, vocab.seen + 3, (2, lm_score.WINDOW)), rng.integers(0, vocab.seen, (2, lm_score.STRIDE))
    real = rng.random(target.shape) < 0.8
    g = model.gradient(rows, target, real)
    loss = lambda: -float((model.log_probabilities(model.hidden(rows), target.reshape(-1)) * real.reshape(-1)).sum() / real.sum())
    for name in model.p:
        for at in np.argsort(-np.abs(g[name]), axis=None)[:2] if name in g else ():
            at = np.unravel_index(at, g[name].shape)
            model.p[name][at] += 1e-5
            up = loss()
            model.p[name][at] -= 2e-5
            assert (up - loss()) / 2e-5 == pytest.approx(g[name][at], abs=1e-5, rel=1e-3), name
            model.p[name][at] += 1e-5


def test_lm_input_rows_move_only_in_steps_that_use_them(monkeypatch):
    """A step visits the rows of its ids alone, whatever the size of the vocabulary, and gives each the sum over its places."""
    rng = np.random.default_rng(8)
    keys, values, at = rng.integers(0, 40, 300) ** 2 // 40, rng.standard_normal((500, 6)), rng.integers(0, 500, 300)
    used, sums = lm_score._sums_by(keys, values, at)
    assert used.tolist() == sorted(set(keys.tolist()))
    assert np.allclose(sums, [values[at[keys == k]].sum(axis=0) for k in used])

    once, n = 50, 1200
    ids = rng.integers(0, once, n * 20)
    ids[7777] = once  # in one text alone
    vocab = lm_score.Vocabulary(np.bincount(ids, minlength=once + 2).astype(float))
    model, seen = lm_score.Attention(vocab), []
    parts = lm_score.Attention.gradient_parts

    def watched(self, rows, *rest, **named):
        seen.append((bool((rows == vocab.place[once]).any()), self.p["e0"][vocab.place[once]].copy()))
        return parts(self, rows, *rest, **named)

    monkeypatch.setattr(lm_score.Attention, "gradient_parts", watched)
    after = lm_score.train(ids, np.full(n, 20), vocab, model=model)
    states = [state for _, state in seen] + [after.p["e0"][vocab.place[once]]]
    moved = [bool((a != b).any()) for a, b in zip(states[:-1], states[1:], strict=True)]
    assert moved == [used for used, _ in seen] and sum(moved) == 1


def test_lm_training_grows_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_ROWS", 50)
    monkeypatch.setattr(lm_score, "ONE_IN", 1)
    ids_of, size = lm_score.subwords(tokenizer("byte_bpe_50k.tiktoken"))
    ids, lengths, _ = lm_score.sequences_of(pa.array([f"one two three four {i} " * 8 for i in range(1200)]), ids_of, size)
    rows = list(enumerate(lm_score._binary(ids, lengths, size).to_pylist()))
    docs = spark.createDataFrame(rows, "id long, ids binary")
    vocab = lm_score.Vocabulary(np.bincount(ids, minlength=size + 1).astype(float))
    start = lm_score.train(ids, lengths, vocab, steps=2)
    after = lm_score.trained_on(start, docs)
    again = lm_score.trained_on(start, docs.repartition(7))
    before, then = (lm_score.log10_probabilities(ids, lengths, m).sum() for m in (start, after))
    assert then > before + 1
    assert all(np.allclose(after.p[k], again.p[k], atol=1e-5) for k in after.p)


def test_lm_training_reaches_the_weights_of_every_row(spark):
    """Each text has an id of its own, whose row only that text can move."""
    n = 400
    rows = [(i, np.array([i, n, n + 1], "<u2").tobytes()) for i in range(n)]
    counts = np.r_[np.ones(n), n, n, 0.0]
    start = lm_score.Attention(lm_score.Vocabulary(counts))
    after = lm_score.trained_on(start, spark.createDataFrame(rows, "id long, ids binary"))
    own = start.vocab.place[:n]
    assert (after.p["e0"][own] != start.p["e0"][own]).any(axis=1).all()


def test_lm_scores_held_out_text_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = lm_score.score(docs, tokenizer("byte_bpe_50k.tiktoken")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] / held[2] > held[1] / held[2] + 0.1


def test_lm_encodes_long_words_and_odd_spaces():
    ids_of, size = lm_score.subwords(tokenizer("byte_bpe_50k.tiktoken"))
    texts = ["x" * 5000, "\u00a0" * 300_000, "a \u2003\u2003 b", "", "Ä" * 3000, " \t A\x0bb\x0c\r\nc ", "É", "a a a"]
    ids, lengths, (words, codes, bounds) = lm_score.sequences_of(pa.array(texts), ids_of, size)
    split = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    words = words.to_pylist()
    assert [[words[c] for c in codes[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == split
    assert [x[-1] for x in np.split(ids, np.cumsum(lengths)[:-1])] == [size] * len(texts) and lengths[3] == 1
    one = lambda ws: ids_of(pa.array(ws))[0].tolist()
    many = ["a", "\u00a0x", "b\u00a0", "don't", "12ab", "...", "\u2003\u2003", "日本", "a\u00a0\u00a0b"]
    flat, sizes = ids_of(pa.array(many))
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [one([w]) for w in many]
    assert np.split(ids, np.cumsum(lengths)[:-1])[5].tolist() == [*one(["a"]), *one(["b"]), *one(["c"]), size]


def test_sql_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, DATA)
        cur = con.execute(sql)
        order = [[c[0] for c in cur.description].index(c) for c in df.columns]
        assert {tuple(r) for r in df.collect()} == {tuple(r[i] for i in order) for r in cur.fetchall()}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The small tables with planted documents: (folder, text of each planted id)."""
    rng = np.random.default_rng(21)
    d = tmp_path_factory.mktemp("planted")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    word = lambda: "".join(rng.choice(list("bdfgklmnprst")) + rng.choice(list("aeiou")) for _ in range(rng.integers(2, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(240), next(r.text for r in bench.orderBy("item_id").collect() if len(r.text.split()) > 20)
    swapped = " ".join(("other" if i % 8 == 5 else w) for i, w in enumerate(passage.split()))
    near = " ".join((word() if i % 13 == 4 else w) for i, w in enumerate(base.split()))
    insults = Counter(w.strip(".,!?").lower() for r in docs.join(labels.where("toxic = 1"), "doc_id").collect() for w in (r.text or "").split())
    mild = {w.strip(".,!?").lower() for r in docs.join(labels.where("toxic = 0"), "doc_id").collect() for w in (r.text or "").split()}
    worst = [w for w, _ in sorted(insults.items(), key=lambda x: -x[1]) if w not in mild and len(w) > 4][:5]
    texts = {
        10**6: base,
        10**6 + 1: base.upper(),
        10**6 + 2: near,
        10**6 + 3: f"{prose(60)} {swapped} {prose(40)}",
        10**6 + 4: f"{prose(30)}. {' '.join(worst)}. {prose(30)}",
        10**6 + 5: prose(150),
        10**6 + 6: None,
        10**6 + 7: "",
        10**6 + 8: "word " * 30000,
        10**6 + 9: "one two three four five six seven eight nine ten",
        10**6 + 10: "one two three four five six seven eight nine eleven",
    }
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], docs.schema)
    docs.unionByName(rows).unionByName(rows.where("doc_id = 1000005")).write.parquet(f"{d}/documents.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return str(d), texts


def test_pipeline_stages_match_brute_force(spark, planted):
    import corpus_pipeline
    from tokenizers import Tokenizer

    d, texts = planted
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], d).cache()
        assert out.columns == docs.columns and out.exceptAll(kept[-1]).count() == 0
        kept.append(out)
    ids = [{r.doc_id for r in k.collect()} for k in kept]
    gone = lambda i: next((n for n, there in enumerate(ids) if i not in there), None)
    m = 10**6
    assert {i - m: gone(i) for i in texts} == {0: 2, 1: None, 2: 3, 3: 4, 4: 1, 5: None, 6: 2, 7: None, 8: None, 9: None, 10: 3}
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept]
    # Toxicity: what the scores say, and most of what is labelled.
    scores = {r.doc_id: r.predicted for r in toxicity.score(kept[0], spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert ids[1] == {i for i in ids[0] if not scores[i]}
    # Exact copies: of equal texts the largest id.
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    best = {}
    for i, t in rows[1].items():
        best[fold(t)] = max(i, best.get(fold(t), i))
    assert ids[2] == set(best.values())
    # Near copies: of each class by the edit distance of all pairs the smallest id.
    order = sorted(ids[2])
    classes = classes_by_force([rows[2][i] or "" for i in order])
    assert ids[3] == {order[c] for c in set(classes)}
    # Benchmark: no document is left that holds an item's whole text.
    items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    holds = lambda t: any(f" {x} " in f" {' '.join(re.findall(r'[^\W_]+', (t or '').lower()))} " for x in items)
    assert {i for i in ids[3] if holds(rows[3][i])} <= ids[3] - ids[4]
    pieces = corpus_pipeline.run(spark, d).collect()
    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    assert {r.doc_id for r in pieces} == ids[4]
    many = Counter(r.doc_id for r in kept[4].collect())
    assert sum(r.length for r in pieces) == sum((len(tok.encode(t or "", add_special_tokens=False).ids) + 1) * many[i] for i, t in rows[4].items())


def test_pipeline_takes_awkward_and_empty_tables(spark, planted):
    import corpus_pipeline

    d, _ = planted
    odd = awkward(spark)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
            assert docs.columns == odd.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d)
        assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(pieces.columns)
        assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_empty_tables_have_the_same_columns_and_types(spark, docs, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    some, none = docs.limit(20), docs.limit(0)
    ops = [
        lambda d: decontaminate.overlaps(d, bench),
        lambda d: token_counts.count_tokens(d, tokenizer("piece_bpe_32k.model"), str(tmp_path / "cache")),
        exact_dedup.exact_dedup,
        pii.find,
        lambda d: packing.pack(d, tokenizer("byte_bpe_50k.json")),
        language.identify,
        near_dup.classes,
        lambda d: toxicity.score(d, labels),
    ]
    for op in ops:
        empty = op(none)
        assert empty.count() == 0 and [(f.name, f.dataType) for f in empty.schema] == [(f.name, f.dataType) for f in op(some).schema]
