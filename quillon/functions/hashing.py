"""Digests, ids and check digits, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finding_id(rule: Column, line: Column, excerpt: Column) -> Column:
    """REV- and ten hex digits of a rule, line and squeezed lower-case excerpt."""
    norm = F.lower(F.regexp_replace(F.trim(excerpt), "\\s+", " "))
    text = F.concat_ws("|", rule, F.coalesce(line.cast("string"), F.lit("")), norm)
    return F.concat(F.lit("REV-"), F.upper(F.substring(F.sha1(text.cast("binary")), 1, 10)))


def _prefixed(data: Column) -> Column:
    """Eight bytes of length, then the data: no two lists of parts read the same."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")), data)


def node_hash(kind: str, *parts: Column) -> Column:
    """SHA-256 of a domain name and parts. A null is the single byte FF, text is tagged "s"."""
    body = _prefixed(F.lit(kind).cast("binary"))
    for p in parts:
        tagged = F.concat(F.lit("s").cast("binary"), _prefixed(p.cast("string").cast("binary")))
        body = F.concat(body, F.coalesce(tagged, F.unhex(F.lit("FF"))))
    return F.sha2(body, 256)


def fold_hash(kind: str, ordered: Column) -> Column:
    """A node over an array of child digests, in their order."""
    return F.sha2(F.concat(_prefixed(F.lit(kind).cast("binary")), F.array_join(ordered, "").cast("binary")), 256)


def merkle_level(rows, keys: list[str], order: str, digest: str, kind: str, name: str):
    """One digest a group, over its children's in order. Children are short digests, folded once per level."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda x: x[digest])
    return rows.groupBy(*keys).agg(fold_hash(kind, ordered).alias(name))


def multiset_hash(kind: str, digest: Column) -> Column:
    """Aggregate: a digest of a bag of digests, whatever their order."""
    return fold_hash(kind, F.array_sort(F.collect_list(digest)))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) from SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def random_uid() -> Column:
    """Thirty-two random hex digits; another value on every evaluation, so write it before it is used twice."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def _added(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def ean13_check(first12: Column) -> Column:
    """The thirteenth digit."""
    # Spelt out digit by digit, as below: a lambda is interpreted, and computes anew what it takes from outside.
    total = _added([F.substring(first12, i, 1).cast("int") * (3 if i % 2 == 0 else 1) for i in range(1, 13)])
    return ((10 - total % 10) % 10).cast("string")


def isbn13(isbn: Column) -> Column:
    """Thirteen digits of an ISBN of 10 or 13; null if it is neither or its check digit is wrong."""
    d = F.upper(F.regexp_replace(isbn, "[^0-9Xx]", ""))
    thirteen = F.when((F.length(d) == 13) & ~d.contains("X") & (ean13_check(F.substring(d, 1, 12)) == F.substring(d, 13, 1)), d)
    body = F.concat(F.lit("978"), F.substring(d, 1, 9))
    value = lambda i: F.when(F.substring(d, i, 1) == "X", 10).otherwise(F.coalesce(F.substring(d, i, 1).try_cast("int"), F.lit(0)))
    total = _added([value(i) * (11 - i) for i in range(1, 11)])
    ten = F.when(d.rlike("^[0-9]{9}[0-9X]$") & (total % 11 == 0), F.concat(body, ean13_check(F.when(d.rlike("^[0-9]{9}[0-9X]$"), body).otherwise("978000000000"))))
    return F.coalesce(ten, F.when(d.rlike("^[0-9]{13}$"), thirteen))


# Module patterns of the digits, and which half uses which.
EAN_L = ("0001101", "0011001", "0010011", "0111101", "0100011", "0110001", "0101111", "0111011", "0110111", "0001011")
EAN_PARITY = ("LLLLLL", "LLGLGG", "LLGGLG", "LLGGGL", "LGLLGG", "LGGLLG", "LGGGLL", "LGLGLG", "LGLGGL", "LGGLGL")


def ean13_bars(code: Column) -> Column:
    """The 95 modules of a 13-digit code as 0 and 1; null for null."""
    right = [x.translate(str.maketrans("01", "10")) for x in EAN_L]
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    digit = lambda i: F.substring(code, i, 1).cast("int")
    parity = F.get(listed(EAN_PARITY), digit(1))
    one = [F.when(F.substring(parity, i - 1, 1) == "L", F.get(listed(EAN_L), digit(i))).otherwise(F.get(listed(x[::-1] for x in right), digit(i))) for i in range(2, 8)]
    two = [F.get(listed(right), digit(i)) for i in range(8, 14)]
    return F.when(code.isNotNull(), F.concat_ws("", F.lit("101"), *one, F.lit("01010"), *two, F.lit("101")))


def catalogue_code(surname: Column) -> Column:
    """Initial in upper case, and 100 plus the sum of the ASCII codes modulo 900."""
    total = F.aggregate(F.transform(F.split(surname, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)
    return F.concat(F.upper(F.substring(surname, 1, 1)), (total % 900 + 100).cast("string"))
