"""Identifiers in text against plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from lakeloom.functions import identifiers


def luhn(text):
    ds = [int(c) for c in text if c in "0123456789"][::-1]
    return bool(ds) and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(ds)) % 10 == 0


def checked(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "card":
        return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(v)
    if kind == "ipv4":
        parts = v.split(".")
        return len(parts) == 4 and all(str(int(p)) == p and int(p) < 256 for p in parts)
    if kind == "iban":
        plain = v.replace(" ", "")
        return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return True


def brute(text):
    out = [(m.start(), kind, m.end(), m[0]) for kind, p in identifiers.PATTERNS.items() for m in re.finditer(p, text or "") if checked(kind, m[0])]
    return sorted(out)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: [(s.start, s.kind, s.end, s.value) for s in r.s] for r in df.select("i", identifiers.identifiers(F.col("text")).alias("s")).collect()}


def test_identifiers(spark):
    iban, card = "DE89370400440532013000", "4111111111111111"
    texts = [None, "", "é a.b+c@mail.example.com. x@y, @z.com a@b@c.de", "ñ10.0.0.1 256.1.1.1 1.2.3.4.5 01.2.3.4 0.0.0.0, 1.2.3", f"{card} 4111-1111 1111-1111 4111111111111112 0000000000000000 {card}9 5500 0000 0000 0004", f"{iban} GB82 WEST 1234 5698 7654 32 DE89370400440532013001 xDE89 3704 0044 0532 0130 00"]
    rng = random.Random(3)
    bits = ["@", ".", " ", "-", "a", "Bc", "12", "1234", "4111", iban[:9], iban, card, "192.168.0.1", "é", "\n", "x@y.z"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    got = found(spark, texts)
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert {s[1] for v in got.values() for s in v} == {"email", "ipv4", "card", "iban"}
    assert [s[3] for s in got[2]] == ["a.b+c@mail.example.com", "b@c.de"] and [s[3] for s in got[5]] == [iban, "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"]


def test_long_texts_take_linear_time(spark):
    n = 60_000
    texts = ["1." * n, "a" * 20 * n, "a@b." * n, "1234 " * n, "AB12" * n, "x@y.z " * n, "10.0.0.1 " * n]
    began = time.perf_counter()
    got = found(spark, texts)
    assert time.perf_counter() - began < 60
    assert len(got[5]) == len(got[6]) == n and got[6][-1][:3] == (9 * (n - 1), "ipv4", 9 * n - 1)


def test_prefix_sums(spark):
    df = spark.range(1).select(identifiers.prefix_sums(F.sequence(F.lit(1).cast("long"), F.lit(1000).cast("long"))).alias("a"), identifiers.prefix_sums(F.array().cast("array<long>")).alias("b"))
    r = df.first()
    assert r.a == [i * (i + 1) // 2 for i in range(1000)] and r.b == []
