import hashlib
import re

from quillon.llm import pii

P = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    out = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(P.items()) for m in p.finditer(text or "") if good(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


TEXTS = [
    "write to a.b+c@mail.example.org or x@y", "a@b.c_x@d.e a@b.c@d.e.f ..@-.- @a.b", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 1.2.3.256 10.0.0.1",
    "4111 1111-1111 1111 and 41111111111111112 4111111111111112", "+1 (234) 567-8901 +12 345 +1-2-3-4-5-6-7-8-9) ++4912345678901", "é@a.bé ñ4111111111111111ß 😀 a@b.de",
    "", None, "a." * 3000 + "@b" + ".c" * 3000, "1" * 20000, "+1" + " " * 5000 + "x", "call +1 (415) 555-0100, mail q@w.er, 8.8.8.8",
]


def test_base_spans(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again"), (None, TEXTS[5], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.digest(pii.find(df, pii.fit(df))).collect()
    assert len(out) == len(rows)
    want = {k: brute(t) for k, t, _ in rows}
    for r in out:
        base = want[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k + ":") for x in base) for k in P), r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",") if r.spans else [])
    empty = df.limit(0)
    assert not pii.find(empty, pii.fit(empty)).collect()


def test_boosting_learns_and_calibrates():
    """Candidates with bit 0 are nearly always right, others hardly ever."""
    counts = [(1, 400, 398), (3, 300, 299), (0, 500, 4), (2, 200, 90)]
    trees = pii.boost(counts)
    score = {m: sum(pii._value(t, m) for t in trees) for m, _, _ in counts}
    assert min(score[1], score[3]) > max(score[0], score[2])
    bar = pii.threshold(trees, counts)
    assert score[2] < bar <= min(score[1], score[3]) + 1e-6
    assert pii.threshold(pii.boost([(0, 100, 20)]), [(0, 100, 20)]) == float("inf")


def test_added_spans_and_redaction(spark):
    """A number without its plus sign is added where such candidates proved right."""
    rows = [(k, f"call +1 (415) 555-{k:04d} now") for k in range(60)] + [(99, "call 1 (415) 555-9999 now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trees = pii.boost([(m, 100, 100) for m in range(8)])
    model = {k: ([], float("inf")) for k in pii.KINDS} | {"phone": (trees, -1.0)}
    found = pii.find(df, model)
    got = {r.doc_id: r.spans for r in pii.digest(found).collect()}
    assert got[99] == "phone:5:21" and got[7] == "phone:5:22"
    text = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert text[99] == "call [PHONE] now" and text[3] == "call [PHONE] now"


def card(k):
    d = f"4539{k:011d}"
    return next(d + c for c in "0123456789" if luhn(d + c))


def test_formats_that_no_base_span_has(spark):
    """National phones, obfuscated emails and cards in other separators or with digits after them are learnt and found; order numbers and failing cards aren't."""
    parts = lambda k, sep: sep.join(re.findall("....", card(k)))
    make = [
        lambda k: ("call ", f"(415) 555-{k:04d}", " now", "phone"), lambda k: ("tel: ", f"0044 20 7946 {k:04d}", "; bye", "phone"),
        lambda k: ("write ", f"jo{k} (at) host[dot]com", " soon", "email"), lambda k: ("write ", f"jo{k} @ host.com", " soon", "email"),
        lambda k: ("pay ", parts(k, "."), " now", "card"), lambda k: ("pay ", parts(k, "/"), " now", "card"), lambda k: ("pay ", parts(k, "_"), " now", "card"),
        lambda k: ("pay ", parts(k, " "), " 123 at once", "card"),
    ]
    rows, want = [], {}
    for k in range(40):
        for j, f in enumerate(make):
            lead, m, tail, kind = f(k + 40 * j)
            want[len(rows)] = (kind, len(lead), len(lead) + len(m))
            rows.append((len(rows), lead + m + tail))
    for k in range(30):
        want[len(rows)] = ("phone", 3, 17)  # no word before it
        rows.append((len(rows), f"at (650) 555-{k:04d} or so"))
    clean = [f"order {10000000 + 7919 * k} of {k}" for k in range(40)] + [f"see you @ noon{k}" for k in range(40)] + [f"ratio {k}.{k + 1}.{k + 2} 12345678" for k in range(40)]
    rows += [(1000 + k, t) for k, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df)
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(df, model)).collect()}
    missed = [(rows[d][1], got[d]) for d, (kind, s, e) in want.items() if f"{kind}:{s}:{e}" not in got[d].split(",")]
    # Digits after a card may by chance make a longer base span of it.
    assert len(missed) <= 8 and all(" 123 at" in t and g.startswith("card:4:") for t, g in missed), (len(missed), len(want), missed[:9])
    assert not any(got[1000 + k] for k in range(len(clean))), [(t, got[1000 + k]) for k, t in enumerate(clean) if got[1000 + k]][:9]


def test_a_format_whose_candidates_are_mostly_wrong_stays_out(spark):
    """The same shape after words for other numbers gets no threshold, nor do sixteen digits without a Luhn sum."""
    rows = [(k, f"order no. (415) 555-{k:04d} now") for k in range(60)] + [(100 + k, f"call (415) 555-{k:04d} now") for k in range(20)]
    rows += [(200 + k, f"pay 4000.0000.{k:04d}.{7 * k:04d} now") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not any("phone" in r.spans or "card" in r.spans for r in pii.digest(pii.find(df, pii.fit(df))).collect())


def test_very_many_matches(spark):
    """A log-like text: lists of matches span many blocks, and the work stays in proportion to them."""
    import time

    text = " ".join(f"10.{k % 256}.0.{k % 200} +49 30 {1000000 + k} a{k}@b.de {k}.{k}" for k in range(6000))
    df = spark.createDataFrame([(1, text), (2, text[:1000])], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.digest(pii.find(df, pii.fit(df))).collect()}
    assert got[1].base_sha256 == hashlib.sha256(",".join(brute(text)).encode()).hexdigest()
    assert (got[1].n_email, got[1].n_ip) == (6000, 6000) and time.time() - began < 120


def test_overlaps_are_settled_in_order(spark):
    from pyspark.sql import functions as F

    spans = [(1.0, 0, 5), (2.0, 3, 8), (1.5, 7, 9), (1.0, 9, 12), (1.0, 9, 13), (0.5, 20, 30), (3.0, 29, 31)] + [(1.0, 40 + 3 * k, 42 + 3 * k) for k in range(600)]
    df = spark.createDataFrame([([{"score": s, "form": 0, "start": a, "end": b} for s, a, b in spans],), ([],)], "g array<struct<score:double,form:int,start:int,end:int>>")
    got = [[(x.start, x.end) for x in r[0]] for r in df.select(pii.best_apart(F.col("g"))).collect()]
    assert got == [[(3, 8), (9, 12), (29, 31)] + [(40 + 3 * k, 42 + 3 * k) for k in range(600)], []]


def test_running_sums(spark):
    from pyspark.sql import functions as F

    sizes = [k % 7 for k in range(1000)]
    rows = spark.createDataFrame([(sizes,), ([],), ([5],)], "s array<int>").select(pii.before(F.col("s"))).collect()
    assert [r[0] for r in rows] == [[sum(sizes[:k]) for k in range(1000)], [], [0]]
