"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base spans are what four patterns and their checks find; they always stay.
High-recall generators propose further spans, which may overlap: written-out
e-mail addresses, addresses with hexadecimal groups, card numbers with unusual
separators, telephone numbers without a plus sign.  Boosted trees score each
proposal from its format and its context, a threshold calibrated for each kind
selects, and of overlapping ones the best stays.

The trees are fitted on the driver to labelled spans that :func:`sample_spans`
makes from templates, and scored as plain column expressions.

Quantifiers are possessive and e-mail and address patterns start only where a
match can, so long runs cost no backtracking and no deep recursion; both leave
the leftmost non-overlapping matches as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import columns_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns, and those of the generators.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}| at ) ?[a-z0-9-]{1,63}+(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?|\.)[a-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?i)(?<![a-z0-9:])(?:[0-9a-f]{1,4}:){3,7}+(?::?[0-9a-f]{1,4}){1,4}+(?![a-z0-9:])",
    "card": r"(?<![0-9])[0-9]{4}[./_ -]{1,3}[0-9]{4}[./_ -]{1,3}[0-9]{4}[./_ -]{1,3}[0-9]{2,7}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-]{1,2}[0-9]{2,4}){1,4}+(?![0-9])",
}
CUES = {
    "email": r"(?i)\b(?:mail|e-mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|ipv6|host|server|address|addr|ping)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|cc|pan)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|telefon|tél|teléfono|whatsapp)\b",
}
AGAINST = r"(?i)\b(?:version|v|isbn|order|invoice|ref|serial|part|id|no|page|pp|chapter|section|date|pos|lat|lon|score|ratio)\b[\s.:#]*$"
FEATURES = ("length", "digits", "letters", "groups", "luhn", "brackets", "cue", "against", "glued", "dots", "bracketed", "worded", "colons", "slashes", "year")


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _sums_before(numbers: Column, chunk: int = 128) -> Column:
    """Sum of the numbers before each place, by sums of chunks and sums within a chunk: a fold that appends would copy all of its result at each step."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    places = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / chunk).cast("int"))

    def of_chunks(chunks: Column) -> Column:
        def from_totals(totals: Column) -> Column:
            def one(own: Column, i: Column) -> Column:
                return _let(total(F.slice(totals, 1, i)), lambda base: F.transform(own, lambda _, j: base + total(F.slice(own, 1, j))))

            return F.flatten(F.transform(chunks, one))

        return _let(F.transform(chunks, total), from_totals)

    cut = F.transform(places, lambda i: F.slice(numbers, i * chunk + 1, chunk))
    return F.when(F.size(numbers) > 0, _let(cut, of_chunks)).otherwise(F.expr("CAST(array() AS array<int>)"))


def _spans(pieces: Column, matches: Column) -> Column:
    """array<struct<start, end, s, before, after>>, offsets in code points, from what lies between matches and the matches."""
    n = F.size(matches)
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,s:string,before:string,after:string>>)")
    lengths = F.zip_with(F.slice(pieces, 1, n), matches, lambda a, m: F.char_length(a) + F.char_length(m))
    zipped = F.arrays_zip(F.slice(pieces, 1, n).alias("a"), matches.alias("m"), F.slice(pieces, 2, n).alias("z"), _sums_before(lengths).alias("at"))

    def span(x: Column) -> Column:
        start = x["at"] + F.char_length(x["a"])
        end = start + F.char_length(x["m"])
        return F.struct(start.alias("start"), end.alias("end"), x["m"].alias("s"), F.right(x["a"], F.lit(24)).alias("before"), F.left(x["z"], F.lit(12)).alias("after"))

    return F.when(n > 0, F.transform(zipped, span)).otherwise(empty)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _holds(kind: str, s: Column) -> Column:
    """The check that a base match of the kind must pass."""
    if kind == "ip":
        parts = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.char_length(_digits(s)).between(14, 19) & _luhn(_digits(s))
    if kind == "phone":
        return F.char_length(_digits(s)).between(10, 15)
    return F.lit(True)


def _features(kind: Column, s: Column, before: Column, after: Column) -> Column:
    """array<double> in the order of FEATURES."""
    digits = _digits(s)
    cue = reduce(lambda c, k: c.when(kind == k, before.rlike(CUES[k])), KINDS[1:], F.when(kind == KINDS[0], before.rlike(CUES[KINDS[0]])))
    values = [
        F.char_length(s),
        F.char_length(digits),
        F.char_length(F.regexp_replace(s, "[^A-Za-z]", "")),
        F.size(F.split(s, "[^A-Za-z0-9]+")),
        (F.char_length(digits).between(13, 19) & _luhn(digits)).cast("int"),
        s.rlike(r"[\[({]").cast("int"),
        cue.cast("int"),
        before.rlike(AGAINST).cast("int"),
        (before.rlike(r"[\w$€£#]$") | after.rlike(r"^(?:\w|[.,]\d|%)")).cast("int"),
        F.char_length(F.regexp_replace(s, r"[^.]", "")),
        s.rlike(r"(?i)[\[({](?:at|dot)[\])}]").cast("int"),
        s.rlike("(?i) dot ").cast("int"),
        F.char_length(F.regexp_replace(s, "[^:]", "")),
        F.char_length(F.regexp_replace(s, "[^/]", "")),
        s.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:$|[^0-9])").cast("int"),
    ]
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def sample_spans(spark: SparkSession, n: int, first: int = 0) -> DataFrame:
    """``n`` labelled proposals: kind, s, before, after, label; templates filled from hashes of the row number, from ``first`` on."""
    number = lambda k, m: F.lpad(F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(10**m)).cast("string"), m, "0")
    group = lambda k: F.substring(F.lower(F.hex(F.xxhash64(F.col("id"), F.lit(k)))), 1, 4)
    pick = lambda k, *words: F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(words))).cast("int"))
    letters = lambda k: F.left(F.translate(F.lower(F.hex(F.xxhash64(F.col("id"), F.lit(k)))), "0123456789", "ghijklmnop"), F.pmod(F.xxhash64("id", F.lit(-k)), F.lit(14)).cast("int") + 1)
    name = pick(1, "anna", "j.smith", "info", "marc_77", "sales", "k-lee")
    host = pick(2, "example", "mail-7", "posteo", "uni", "firma")
    top = pick(3, "com", "org", "net", "de", "fr", "es", "co", "io")
    word = pick(4, "they", "was", "look", "the house", "here", "come", "meet")
    sep = pick(5, "-", " ", ".", " ")
    neutral = pick(6, "the of and ", "it was in, ", "", "mit der ", "que la ", ". Es el ")
    rest = pick(7, " and the", ", then", ".", "", " und der", " la")
    # A sum-of-digits check is met by one number in ten; doubling the fourth digit's complement is left to chance and to luhn below.
    sixteen = F.concat(number(10, 4), F.lit("|"), number(11, 4), F.lit("|"), number(12, 4), F.lit("|"), number(13, 4))
    odd = pick(8, ".", "/", "_", " - ")
    rows = [
        ("email", F.concat(name, pick(9, " [at] ", "(at)", " (at) ", "[at]", "{at}"), host, pick(14, ".", " [dot] ", "(dot)", " dot "), top), neutral, rest, 1),
        ("email", F.concat(name, F.lit(" at "), host, pick(15, " dot ", " [dot] ", "(dot)"), top), pick(16, "mail ", "contact: ", "the of ", "write to "), rest, 1),
        ("email", F.concat(word, F.lit(" at "), pick(17, "noon", "the", "home", "hand", "3"), F.lit("."), pick(18, "The", "And", "It", "30", "Then")), neutral, rest, 0),
        ("email", F.concat(letters(80), F.lit(" at "), letters(81), F.lit("."), letters(82)), neutral, rest, 0),
        ("email", F.concat(letters(83), F.lit(" at "), letters(84), F.lit("."), top), neutral, rest, 0),
        ("email", F.concat(word, F.lit(" at "), pick(19, "noon", "the", "hand"), F.lit(". "), pick(20, "The", "And", "It")), neutral, rest, 0),
        ("ip", F.concat_ws(":", *[group(k) for k in range(30, 38)]), pick(21, "host ", "from ", "", "ip "), rest, 1),
        ("ip", F.concat(group(30), F.lit(":"), group(31), F.lit(":"), group(32), F.lit("::"), group(33)), pick(21, "host ", "from ", "", "ip "), rest, 1),
        ("ip", F.concat_ws(":", *[number(k, 2) for k in range(40, 44)]), pick(22, "time ", "at ", "score ", ""), rest, 0),
        ("card", F.translate(sixteen, "|", "."), pick(23, "card ", "visa: ", neutral_word(), "credit card "), rest, -1),
        ("card", F.regexp_replace(sixteen, r"\|", odd), neutral, rest, -1),
        ("card", F.translate(sixteen, "|", "-"), pick(24, "serial ", "order no. ", "isbn ", "ref: "), rest, 0),
        ("phone", F.concat(F.lit("("), number(50, 3), F.lit(") "), number(51, 3), F.lit("-"), number(52, 4)), pick(25, "tel ", "call ", "", "the ", "phone: "), rest, 1),
        ("phone", F.concat(F.lit("0"), number(53, 3), sep, number(54, 3), sep, number(55, 4)), pick(26, "tel. ", "Telefon ", "call me: ", "mobile "), rest, 1),
        ("phone", F.concat(number(56, 4), F.lit("-"), number(57, 2), F.lit("-"), number(58, 2)), pick(27, "date ", "on ", "", "since "), rest, 0),
        ("phone", F.concat(F.lit("20"), number(59, 2), pick(28, "-", ".", "/"), number(57, 2), pick(28, "-", ".", "/"), number(58, 2)), neutral, rest, 0),
        ("phone", F.concat(number(60, 2), sep, number(61, 3), sep, number(62, 3)), pick(29, "order ", "ref ", "version ", "page ", "the "), rest, 0),
        ("phone", F.concat_ws(" ", *[number(k, 2) for k in range(63, 66)]), neutral, rest, 0),
        ("phone", F.concat_ws(".", *[number(k, 3) for k in range(66, 70)]), neutral, rest, 0),
    ]
    cases = F.array(*[F.struct(F.lit(k).alias("kind"), s.alias("s"), b.alias("before"), a.alias("after"), F.lit(y).alias("label")) for k, s, b, a, y in rows])
    made = spark.range(first, first + n).select(F.get(cases, F.pmod(F.col("id"), F.lit(len(rows))).cast("int")).alias("x")).select("x.*")
    # Card numbers are labelled by their check digit.
    return made.withColumn("label", F.when(F.col("label") < 0, _luhn(_digits(F.col("s"))).cast("int")).otherwise(F.col("label")))


def neutral_word() -> str:
    return "the number "


@dataclass(frozen=True)
class Trees:
    """Trees of two levels as (feature, cut, left feature, left cut, right feature, right cut, four leaves); thresholds by kind."""

    start: float
    trees: tuple[tuple, ...]
    thresholds: dict[str, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, c, lf, lc, rf, rc, leaves in self.trees:
            low = x[:, f] <= c
            out += np.where(low, np.where(x[:, lf] <= lc, leaves[0], leaves[1]), np.where(x[:, rf] <= rc, leaves[2], leaves[3]))
        return out

    def column(self, x: Column) -> Column:
        def one(t: tuple) -> Column:
            f, c, lf, lc, rf, rc, leaves = t
            low = F.when(x[lf] <= lc, F.lit(leaves[0])).otherwise(F.lit(leaves[1]))
            high = F.when(x[rf] <= rc, F.lit(leaves[2])).otherwise(F.lit(leaves[3]))
            return F.when(x[f] <= c, low).otherwise(high)

        return reduce(lambda a, t: a + one(t), self.trees, F.lit(self.start))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, float]:
    best = (0.0, 0, float("inf"))
    for f in range(x.shape[1]):
        for c in np.unique(x[rows, f])[:-1]:
            low = rows & (x[:, f] <= c)
            high = rows & ~low
            gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
            if gain > best[0] + 1e-9:
                best = (gain, f, float(c))
    return best[1], best[2]


def boost(x: np.ndarray, y: np.ndarray, kinds: list[str], rounds: int = 24, rate: float = 0.4, precision: float = 0.98) -> Trees:
    """Newton boosting on the logistic loss; a kind's threshold is the least that reaches ``precision`` on every third row, which is not trained on."""
    held = np.arange(len(y)) % 3 == 2
    tx, ty = x[~held], y[~held].astype(float)
    start = float(np.log((ty.mean() + 1e-6) / (1 - ty.mean() + 1e-6)))
    raw, trees = np.full(len(ty), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = ty - p, np.maximum(p * (1 - p), 1e-6)
        f, c = _split(tx, g, h, np.ones(len(ty), bool))
        low = tx[:, f] <= c
        lf, lc = _split(tx, g, h, low)
        rf, rc = _split(tx, g, h, ~low)
        parts = [low & (tx[:, lf] <= lc), low & (tx[:, lf] > lc), ~low & (tx[:, rf] <= rc), ~low & (tx[:, rf] > rc)]
        leaves = tuple(float(rate * g[q].sum() / (h[q].sum() + 1)) for q in parts)
        trees.append((f, c, lf, lc, rf, rc, leaves))
        raw = Trees(start, tuple(trees), {}).raw(tx)
    model = Trees(start, tuple(trees), {})
    scores, of = model.raw(x), np.array(kinds)
    thresholds = {}
    for kind in KINDS:
        rows = held & (of == kind)
        cuts = [t for t in np.unique(scores[rows]) if y[rows & (scores >= t)].mean() >= precision] if rows.any() else []
        thresholds[kind] = float(min(cuts, default=np.inf)) - 1e-9
    return Trees(start, tuple(trees), thresholds)


_FITTED: dict[int, Trees] = {}


def fitted(spark: SparkSession, train_rows: int = 3400) -> Trees:
    """The trees for ``train_rows`` sample spans; fitted once in a process."""
    if train_rows not in _FITTED:
        rows = sample_spans(spark, train_rows).select("kind", "label", _features(F.col("kind"), F.col("s"), F.col("before"), F.col("after")).alias("x"))
        got = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("kind", "label", "x"))).collect()]
        _FITTED[train_rows] = boost(np.array([r["x"] for r in got]), np.array([r["label"] for r in got]), [r["kind"] for r in got])
    return _FITTED[train_rows]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 3400) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and digest are of the base spans; ``spans`` has all of them, as
    kind:start:end in code points (end exclusive), by start and then kind.
    Proposals that touch a base span, or a better proposal, are dropped; of equal
    ones the first stays.  Null texts count as empty.  Repeated rows and null ids
    each get their row.  Extra columns are ignored.
    """
    trees = fitted(docs.sparkSession, train_rows)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = columns_of(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    sources = [("b", BASE), ("p", PROPOSED)]
    # Texts without the characters that a kind needs are not searched for it.
    needs = {"b_email": F.contains("text", F.lit("@")), "b_phone": F.contains("text", F.lit("+")), "p_ip": F.contains("text", F.lit(":"))}
    digit = F.col("text").rlike("[0-9]")
    split_up = []
    for tag, patterns in sources:
        for kind in KINDS:
            on = needs.get(f"{tag}_{kind}", F.col("text").rlike(r"(?i)[\[({ ]at[\])} ]") if kind == "email" else digit)
            pieces, matches = _matches(F.col("text"), patterns[kind])
            split_up += [F.when(on, pieces).alias(f"{tag}_{kind}_pieces"), F.when(on, matches).alias(f"{tag}_{kind}_matches")]
    cut = rows.select("id", *split_up)
    none = F.expr("CAST(array() AS array<string>)")
    spans = [
        _spans(F.coalesce(F.col(f"{tag}_{kind}_pieces"), none), F.coalesce(F.col(f"{tag}_{kind}_matches"), none)).alias(f"{tag}_{kind}")
        for tag, _ in sources
        for kind in KINDS
    ]
    found = cut.select("id", *spans)

    def base(kind: str) -> Column:
        kept = F.filter(F.col(f"b_{kind}"), lambda x: _holds(kind, x["s"]))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))

    def proposed(kind: str) -> Column:
        scored = F.transform(
            F.col(f"p_{kind}"),
            lambda x: F.struct(
                x["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                x["end"].alias("end"),
                trees.column(_features(F.lit(kind), x["s"], x["before"], x["after"])).alias("score"),
            ),
        )
        return F.filter(scored, lambda x: x["score"] >= trees.thresholds[kind])

    found = found.select("id", *[base(k).alias(f"base_{k}") for k in KINDS], *[proposed(k).alias(f"more_{k}") for k in KINDS])
    found = found.select(
        "id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.concat(*[F.col(f"base_{k}") for k in KINDS])).alias("base"),
        F.concat(*[F.col(f"more_{k}") for k in KINDS]).alias("more"),
    )
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"]))))
    free = F.filter("more", lambda x: ~F.exists("base", lambda b: meet(x, b)))
    found = found.withColumn("more", F.when(F.size("more") > 0, free).otherwise(F.col("more")))
    added = F.filter("more", lambda x: ~F.exists("more", lambda o: meet(x, o) & better(o, x)))
    found = found.withColumn("added", F.transform(added, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    return found.select(
        F.col("id").alias(id_col),
        *[f"n_{k}" for k in KINDS],
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
