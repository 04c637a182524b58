"""Personal data by candidate gradient boosting, with DataFrame functions only.

Exact patterns give the base spans (email, ip, card, phone). Wider generators
propose overlapping candidate spans of each kind. Boosted depth-two trees score
a candidate by yes/no features of its format and context, none of which checks
what the exact patterns check last (Luhn sum, number ranges). They learn from
the corpus itself, by labels that don't need a base span (``label``): a candidate
is a positive if it overlaps a base span of its kind, passes the kind's last check
by itself (a card in any separators or with digits after it), reads as an email
once (at) and [dot] are put back, or is a national phone format after a word such
as "call". Phone formats without such a word, and candidates that run on over a
good core, speak neither for nor against. All other candidates are negatives. They
enter as counts by kind, feature mask and half (a hash of the text), at most
8 * 2**18 rows whatever the input; the trees are grown on one half's counts and
become one SQL expression. Per kind and format (``FORMS``), the threshold is set on
the other half: the lowest score from which on labelled candidates are right in at
least ``PRECISION`` of cases, by the lower limit of a confidence interval, so the
evidence needed depends on the counts alone. Candidates above it that touch no base
span of their kind are added; of overlapping ones the best-scored.

Matching is leftmost and non-overlapping per kind; positions are in code points,
ends exclusive. Possessive repeats and left boundaries make each pattern linear
in long runs, and match as the plain ones do. Lists of matches are walked in blocks,
overlaps are looked up in a mask, and overlapping candidates are settled in one pass,
so a text with very many matches costs in proportion to them (but for the copying of
one block, and sorting).

Defined results: null text counts as empty and has no spans; repeated rows each
get their row; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The exact patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators: whatever might be of the kind, and its usual formats by themselves. An exact
#: pattern runs on into digits that follow and then fails; a format finds what it should have been.
_AT, _DOT = r"[(\[](?i:at)[)\]]", r"[(\[](?i:dot)[)\]]"
_CARD = r"[0-9]{4}(SEP)(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{6}\1[0-9]{5})"
_NATIONAL = r"\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}"
_TRUNK = r"\(?0[1-9][0-9]{1,4}\)?[\x20/-]{1,3}[0-9]{3,4}[\x20-]?[0-9]{3,4}"
_ABROAD = r"00[1-9][0-9]{0,2}\x20?\(?[0-9]{2,4}\)?[\x20-][0-9]{3,4}[\x20-]?[0-9]{3,4}"
WIDE = {
    "email": (rf"(?:\G|(?<![A-Za-z0-9._%+-])(?<!(?i:dot)[)\]]))[A-Za-z0-9._%+-]++(?:{_DOT}[A-Za-z0-9._%+-]++)*+[\x20]?(?:@|{_AT})[\x20]?[A-Za-z0-9-]++(?:(?:\.|\x20?{_DOT}\x20?)[A-Za-z0-9-]++)*+",),
    "ip": (r"(?:\G|(?<![0-9.]))[0-9]++(?:\.[0-9]++)++", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])"),
    "card": (r"(?:\G|(?<![0-9]))[0-9](?:[\x20._/-]?[0-9]){7,}+", rf"(?<![0-9]){_CARD.replace('SEP', '[\x20._/-]?')}(?![0-9])"),
    "phone": (
        r"(?:\+|\b00|\()?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+",
        r"\+[0-9]{1,3}\x20?\(?[0-9]{2,4}\)?[\x20-][0-9]{3}-[0-9]{4}(?![0-9])",
        rf"(?<![0-9+.(])(?<![0-9)][\x20.-])(?:{_NATIONAL}|{_TRUNK}|{_ABROAD})(?![0-9])",
    ),
}
#: What a text needs for a kind to be looked for at all.
NEEDS = {"email": rf"@|{_AT}", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
#: Share of positives among labelled candidates that a threshold asks for, by the lower limit of Wilson's
#: interval that holds the true share with 75 % from one side.
PRECISION, SURE = 0.95, 0.6745
#: Elements of a list that a fold appends to at a time.
BLOCK = 256
ROUNDS, SHRINK = 25, 0.3


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _index(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _blocks(values: Column) -> Column:
    """A list in blocks."""
    many = F.ceil(F.size(values) / F.lit(float(BLOCK))).cast("int")
    return F.transform(_index(many), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def before(sizes: Column) -> Column:
    """array<int>: to each of the sizes, the sum of those before it."""

    def running(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("pos"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, zero, lambda acc, x: F.struct((acc["pos"] + x).alias("pos"), F.array_append(acc["out"], acc["pos"]).alias("out")), lambda acc: acc["out"])

    def all_of(blocks: Column) -> Column:
        total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        return F.flatten(F.zip_with(blocks, running(total, F.lit(0)), running))

    return let(_blocks(sizes), all_of)


def spans(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<start, end, m, before, after>>: all matches, with up to 24 characters before and 1 after."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(b: Column, i: Column) -> Column:
        piece, m = F.get(b["p"], i), F.get(b["h"], i)
        start = F.get(b["at"], i) + F.length(piece)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"), F.right(piece, F.lit(24)).alias("before"), F.left(F.get(b["p"], i + 1), F.lit(1)).alias("after"))

    def placed(b: Column) -> Column:
        sizes = F.zip_with(F.slice(b["p"], F.lit(1), F.size(b["h"])), b["h"], lambda p, h: F.length(p) + F.length(h))
        return let(F.struct(b["p"].alias("p"), b["h"].alias("h"), before(sizes).alias("at")), lambda c: F.transform(_index(F.size(c["h"])), lambda i: one(c, i)))

    found = let(F.struct(pieces.alias("p"), hits.alias("h")), placed)
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    return found if needs is None else F.when(text.rlike(needs), found).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: What a match must pass to be a base span.
VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.length(digits(m)).between(12, 19) & F.call_function("luhn_check", digits(m)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}
_NEEDS_BASE = NEEDS | {"email": "@", "phone": r"\+[0-9]"}


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(spans(text, BASE[kind], _NEEDS_BASE[kind]), lambda s: VALID[kind](s["m"]))


#: Yes/no features of a candidate, in the order of their bits.
FEATURES: tuple[Callable[[Column], Column], ...] = (
    lambda s: F.length(digits(s["m"])) >= 9,
    lambda s: F.length(digits(s["m"])).between(10, 12),
    lambda s: F.length(digits(s["m"])) == 16,
    lambda s: F.length(digits(s["m"])) > 15,
    lambda s: s["m"].startswith("+"),
    lambda s: s["m"].contains("("),
    lambda s: s["m"].rlike("[\\x20._/-]"),
    lambda s: s["m"].rlike("^[^.]+(?:\\.[^.]+){3}$"),
    lambda s: s["m"].rlike(r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"),
    lambda s: s["m"].rlike(r"^\+[0-9]{1,3}\x20?\(?[0-9]{2,4}\)?[\x20-][0-9]{3}-[0-9]{4}$"),
    lambda s: s["m"].rlike(rf"(?:\.|{_DOT}\x20?)[A-Za-z]{{2,}}$"),
    lambda s: s["m"].rlike(rf"\x20@|@\x20|{_AT}|{_DOT}"),
    lambda s: (s["before"] == "") | s["before"].rlike("[\\s:;,(\"'<]$"),
    lambda s: (s["after"] == "") | s["after"].rlike("^[\\s.,;:!?)\"'>]"),
    lambda s: s["m"].rlike(rf"{_AT}|{_DOT}"),
    lambda s: s["m"].rlike(f"^{_CARD.replace('SEP', '[._/]')}$"),
    lambda s: s["m"].rlike(f"^(?:{_NATIONAL}|{_TRUNK})$"),
    lambda s: s["m"].rlike(f"^{_ABROAD}$"),
)
#: The bits of FEATURES that tell a format: separate ones are calibrated by themselves.
FORMS = sum(1 << bit for bit in (7, 8, 9, 11, 14, 15, 16, 17))
_PHONE_WORD = r"(?i)(?<![a-z])(?:(?:tele|cell)?phone|tel|telefon|tél|call|dial|ring|fax|mobile|cell|móvil|llame|appel|ruf|handy|whatsapp|sms)[a-zéó]*\.?(?:\x20(?:us|me|at|on|no|nr|number|now|an|unter|au|al))*[.:\x20(]*$"
_OTHER_WORD = r"(?i)(?<![a-z])(?:order|invoice|id|isbn|item|ref|reference|serial|account|ticket|part|no|nr|bestellung|rechnung|facture|pedido)\.?[\x20:#.]*$"


def label(s: Column, kind: str, known: Column) -> Column:
    """1: right, 0: wrong, null: speaks neither for nor against."""
    m = s["m"]
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(m, rf"\x20?(?:@|{_AT})\x20?", "@"), rf"\x20?{_DOT}\x20?", ".")
        return F.when(known | plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:[a-z]{2,}|[A-Z]{2,})$"), 1).otherwise(0)
    if kind == "ip":
        return F.when(known | VALID["ip"](m), 1).otherwise(0)
    if kind == "card":
        core = F.exists(F.regexp_extract_all(m, F.lit(rf"(?<![0-9]){_CARD.replace('SEP', '[\x20._/-]?')}(?![0-9])"), F.lit(0)), VALID["card"])
        return F.when(known | VALID["card"](m), 1).when(~core, 0)
    core = m.rlike(WIDE["phone"][1]) | m.rlike(WIDE["phone"][2])
    shaped = m.rlike(f"^(?:{_NATIONAL}|{_TRUNK}|{_ABROAD})$")
    other = s["before"].rlike(_OTHER_WORD)
    good = F.length(F.regexp_replace(digits(m), "^00", "")).between(9, 15)
    return F.when(known | (m.startswith("+") & good) | (shaped & good & s["before"].rlike(_PHONE_WORD)), 1).when(other | ~core, 0)


def candidates(text: Column, kind: str, base: Column) -> Column:
    """array<struct<start, end, mask, known, label>>: candidates with their features, whether they overlap a base span, and their labels."""

    def one(s: Column, covered: Column) -> Column:
        mask = F.lit(0)
        for bit, feature in enumerate(FEATURES):
            mask = mask + F.when(feature(s), 1 << bit).otherwise(0)
        known = F.contains(F.substring(covered, s["start"] + 1, s["end"] - s["start"]), F.lit(b"1"))
        return let(known, lambda k: F.struct(s["start"].alias("start"), s["end"].alias("end"), mask.alias("mask"), k.alias("known"), label(s, kind, k).alias("label")))

    def once(found: Column) -> Column:
        """Without a span that two generators propose."""
        return F.filter(found, lambda c, i: (i == 0) | (F.get(found, i - 1)["start"] != c["start"]) | (F.get(found, i - 1)["end"] != c["end"]))

    found = F.concat(*[spans(text, pattern, NEEDS[kind]) for pattern in WIDE[kind]])
    rated = let(covered_mask(base), lambda covered: F.transform(found, lambda s: one(s, covered)))
    return let(F.array_sort(rated), once)


def covered_mask(base: Column) -> Column:
    """Bytes, one a code point up to the last base span's end: "1" in base spans, "0" elsewhere."""
    return F.array_join(
        F.transform(base, lambda b, i: F.concat(F.repeat(F.lit("0"), b["start"] - F.coalesce(F.get(base, i - 1)["end"], F.lit(0))), F.repeat(F.lit("1"), b["end"] - b["start"]))), ""
    ).cast("binary")


# --- boosting, on counts by mask ---------------------------------------------------------


def _split(rows: list[tuple[int, float, float]], used: tuple[int, ...]) -> int | None:
    """The feature that best parts rows (mask, gradient, weight)."""
    gain = lambda part: sum(g for _, g, _ in part) ** 2 / (sum(h for _, _, h in part) + 1.0)
    best, most = None, gain(rows) + 1e-9
    for f in range(len(FEATURES)):
        if f not in used:
            yes, no = [r for r in rows if r[0] >> f & 1], [r for r in rows if not r[0] >> f & 1]
            if yes and no and (g := gain(yes) + gain(no)) > most:
                best, most = f, g
    return best


def _grow(rows: list[tuple[int, float, float]], depth: int, used: tuple[int, ...] = ()):
    f = _split(rows, used) if depth else None
    if f is None:
        return SHRINK * sum(g for _, g, _ in rows) / (sum(h for _, _, h in rows) + 1.0)
    return f, _grow([r for r in rows if r[0] >> f & 1], depth - 1, (*used, f)), _grow([r for r in rows if not r[0] >> f & 1], depth - 1, (*used, f))


def _value(tree, mask: int) -> float:
    while isinstance(tree, tuple):
        tree = tree[1] if mask >> tree[0] & 1 else tree[2]
    return tree


def boost(counts: list[tuple[int, int, int]]) -> list:
    """Trees from (mask, candidates, positives): logistic loss, Newton leaves."""
    margin, trees = {m: 0.0 for m, _, _ in counts}, []
    for _ in range(ROUNDS if counts else 0):
        rows = []
        for m, n, pos in counts:
            p = 1 / (1 + math.exp(-margin[m]))
            rows.append((m, pos - n * p, n * p * (1 - p)))
        trees.append(_grow(rows, 2))
        margin = {m: v + _value(trees[-1], m) for m, v in margin.items()}
    return trees


def sure_share(n: int, pos: int) -> float:
    """Lower limit of Wilson's confidence interval for the share of positives."""
    z, p = SURE, pos / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def threshold(trees: list, counts: list[tuple[int, int, int]]) -> float:
    """The lowest score from which on at least PRECISION are surely right; infinite if none is."""
    best, n, pos = math.inf, 0, 0
    ranked: dict[float, list[int]] = {}
    for m, k, p in counts:
        at = ranked.setdefault(round(sum(_value(t, m) for t in trees), 9), [0, 0])
        at[0] += k
        at[1] += p
    for s in sorted(ranked, reverse=True):
        n, pos = n + ranked[s][0], pos + ranked[s][1]
        if ranked[s][1] < PRECISION * ranked[s][0]:
            break
        if sure_share(n, pos) >= PRECISION:
            best = s
    return best


def score(trees: list, mask: Column) -> Column:
    def put(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(mask.bitwiseAND(F.lit(1 << tree[0])) != 0, put(tree[1])).otherwise(put(tree[2]))

    total = F.lit(0.0)
    for tree in trees:
        total = total + put(tree)
    return total


def bars(trees: list, counts: list[tuple[int, int, int]]) -> dict[int, float]:
    """Threshold by format, where there is one."""
    found = {form: threshold(trees, [c for c in counts if c[0] & FORMS == form]) for form in sorted({m & FORMS for m, _, _ in counts})}
    return {form: bar for form, bar in found.items() if math.isfinite(bar)}


#: Per kind its trees, and its threshold or thresholds by format.
Fitted = dict[str, tuple[list, float | dict[int, float]]]


def fit(docs: DataFrame, text_col: str = "text") -> Fitted:
    """Per kind its trees and thresholds by format, from the labelled candidates of all documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("t")).where(F.col("t").rlike("|".join(dict.fromkeys(NEEDS.values()))))
    rows = rows.withColumns({f"b_{k}": base_spans(F.col("t"), k) for k in KINDS})
    found = F.flatten(F.array(*[_tag(candidates(F.col("t"), k, F.col(f"b_{k}")), k) for k in KINDS]))
    half = F.pmod(F.xxhash64("t"), F.lit(2)).alias("half")
    counts = rows.select(half, F.inline(found)).where("label is not null").groupBy("kind", "mask", "half").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    got = sorted(tuple(r) for r in counts.collect())  # at most 8 * 2**18 rows
    out = {}
    for kind in KINDS:
        grow, rest = ([(m, n, p) for k, m, half, n, p in got if k == kind and half == h] for h in (0, 1))
        trees = boost(grow)
        out[kind] = (trees, bars(trees, rest))
    return out


def _tag(found: Column, kind: str) -> Column:
    return F.transform(found, lambda c: F.struct(F.lit(kind).alias("kind"), c["mask"].alias("mask"), c["label"].alias("label")))


def find(docs: DataFrame, model: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, text, and arrays base and spans of struct<start, kind (its place in KINDS), end>, sorted."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.withColumns({f"b_{k}": base_spans(F.col("text"), k) for k in KINDS})

    def plain(spans_: Column, kind: str) -> Column:
        place = F.lit(KINDS.index(kind))
        return F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), place.alias("kind"), s["end"].alias("end")))

    def above(c: Column, bar: float | dict[int, float]) -> Column:
        if not isinstance(bar, dict):
            return c["score"] >= bar - 1e-6
        good = F.lit(False)
        for form, least in bar.items():
            good = good | ((c["form"] == form) & (c["score"] >= least - 1e-6))
        return good

    def added(kind: str) -> Column:
        trees, bar = model[kind]
        rated = F.transform(F.filter(candidates(F.col("text"), kind, F.col(f"b_{kind}")), lambda c: ~c["known"]), lambda c: F.struct(score(trees, c["mask"]).alias("score"), c["mask"].bitwiseAND(F.lit(FORMS)).alias("form"), c["start"].alias("start"), c["end"].alias("end")))
        good = F.filter(rated, lambda c: above(c, bar))
        return plain(best_apart(good), kind)

    base = F.flatten(F.array(*[plain(F.col(f"b_{k}"), k) for k in KINDS]))
    extra = [added(k) for k in KINDS if (bool(bar) if isinstance(bar := model[k][1], dict) else math.isfinite(bar))]
    out = out.withColumn("base", F.array_sort(base))
    return out.select("doc_id", "text", "base", F.array_sort(F.concat("base", *extra)).alias("spans"))


def best_apart(found: Column) -> Column:
    """Of candidates in order of start and end, some that don't overlap: each is held until one begins after it, and gives way to a better-scored one before that."""
    one = "struct<score:double,form:int,start:int,end:int>"
    none, empty = F.lit(None).cast(one), F.array().cast(f"array<{one}>")

    def step(acc: Column, c: Column) -> Column:
        top = acc["top"]
        clear = top.isNull() | (c["start"] >= top["end"])
        kept = F.when(top.isNotNull() & clear, F.array_append(acc["out"], top)).otherwise(acc["out"])
        return F.struct(F.when(clear | (c["score"] > top["score"]), c).otherwise(top).alias("top"), kept.alias("out"))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(b, F.struct(acc["top"].alias("top"), empty.alias("out")), step)
        return let(inner, lambda x: F.struct(x["top"].alias("top"), F.array_append(acc["outs"], x["out"]).alias("outs")))

    start = F.struct(none.alias("top"), F.array().cast(f"array<array<{one}>>").alias("outs"))
    return F.aggregate(let(found, _blocks), start, block, lambda acc: F.concat(F.flatten(acc["outs"]), F.when(acc["top"].isNull(), empty).otherwise(F.array(acc["top"]))))


def joined(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts and hash of base spans, and all spans."""
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _count(place: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == F.lit(place))).cast("long")


def redact(found: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; of overlapping spans the first one counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, s["start"] - acc["pos"]), F.get(names, s["kind"]))
        return F.when(s["start"] >= acc["pos"], F.struct(s["end"].alias("pos"), piece.alias("out"))).otherwise(F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return found.select("doc_id", F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.length("text")))).alias("text"))
