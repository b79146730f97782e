"""Identifiers in running text whose form or check digits can be verified, with their spans.

Only built-in functions: a pattern finds candidates, an expression checks each.
Patterns match whole runs and never give anything back (possessive
quantifiers), so that time is linear in a text and no match recurses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix sums are taken over so many numbers at a time, as appending to an array copies it.
CHUNK = 256
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ipv4": r"[0-9]++(?:\.[0-9]++)*+",
    "card": r"[0-9]{4}+(?:[ -][0-9]{4}+){3}+|[0-9]++",
    "iban": r"[A-Z]{2}+[0-9]{2}+(?:(?: [A-Z0-9]{4}+){2,7}+(?: [A-Z0-9]{1,3}+)?+|[A-Z0-9]++)",
}


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(values: Column) -> Column:
    """The sums of an array of longs before each of its elements, in time linear in them: within chunks, after the totals of the chunks before."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")

    def run(xs: Column, first: Column) -> Column:
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all"))
        return F.aggregate(xs, F.struct(first.alias("sum"), none.alias("all")), step, lambda a: a["all"])

    cut = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, CHUNK)))
    totals = lambda cs: F.transform(cs, lambda c: F.aggregate(c, zero, lambda a, x: a + x))
    sums = _let(cut, lambda cs: _let(run(totals(cs), zero), lambda before: F.flatten(F.transform(cs, lambda c, i: run(c, F.get(before, i))))))
    return F.coalesce(sums, none)


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the pattern's matches from the left: code points, end exclusive. A null text has none.

    The pattern must not match the empty string. Splitting at the matches gives
    the pieces between them; the lengths of both add up to the places.
    """
    text = F.coalesce(text, F.lit(""))
    length = lambda x: F.length(x).cast("long")
    found = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))

    def located(m: Column) -> Column:
        steps = F.transform(m["matches"], lambda x, i: length(F.get(m["pieces"], i)) + length(x))
        start = lambda before, i: before + length(F.get(m["pieces"], i))
        span = lambda before, i: F.struct(start(before, i).alias("start"), (start(before, i) + length(F.get(m["matches"], i))).alias("end"), F.get(m["matches"], i).alias("value"))
        return _let(steps, lambda s: F.transform(prefix_sums(s), span))

    return F.when(text.rlike(pattern), _let(found, located)).otherwise(F.array().cast("array<struct<start:long,end:long,value:string>>"))


def _digits(text: Column) -> Column:
    """The digits of a text as an array of ints."""
    return F.transform(F.array_remove(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), ""), lambda x: x.cast("int"))


def luhn_valid(text: Column) -> Column:
    """Whether the digits end in the check digit of Luhn's formula; all else is left out. False without digits."""
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = lambda ds: F.aggregate(F.transform(F.reverse(ds), lambda x, i: F.when(i % 2 == 1, doubled(x)).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return _let(_digits(text), lambda ds: (F.size(ds) > 0) & (total(ds) % 10 == 0))


def card_valid(text: Column) -> Column:
    """13 to 19 digits, not all the same, of which Luhn's formula holds."""
    n = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return n.between(13, 19) & (F.size(F.array_distinct(_digits(text))) > 1) & luhn_valid(text)


def iban_valid(text: Column) -> Column:
    """15 to 34 letters and digits whose number, the first four moved to the end and A to Z as 10 to 35, is 1 modulo 97."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).when(c.between("A", "Z"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a)
    return F.length(plain).between(15, 34) & (F.aggregate(moved, F.lit(0), step) == 1)


def ipv4_valid(text: Column) -> Column:
    """Four numbers from 0 to 255 without leading zeros."""
    parts = F.split(text, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda x: x.rlike("^(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def identifiers(text: Column) -> Column:
    """Array of (kind, start, end, value) of e-mail addresses, IPv4 addresses, payment cards and IBANs, by start, then kind."""
    checks = {"email": lambda _: F.lit(True), "ipv4": ipv4_valid, "card": card_valid, "iban": iban_valid}

    def of(kind: str) -> Column:
        valid = F.filter(spans(text, PATTERNS[kind]), lambda s: checks[kind](s["value"]))
        return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    return F.array_sort(F.concat(*map(of, PATTERNS)))
