"""Checks on identifiers as Column functions: surface text in, nullable boolean out (None: can't tell)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def only(text: Column, chars: str = "0-9") -> Column:
    return F.regexp_replace(text, f"[^{chars}]", "")


def digits(text: Column) -> Column:
    """Array of the decimal digits of the text."""
    return F.transform(F.filter(F.split(only(text), ""), lambda c: c != ""), lambda c: c.cast("int"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def weighted(text: Column, weights: list[int]) -> Column:
    """Sum of the first digits times the weights; null where there are fewer digits than weights."""
    d = digits(text)
    products = F.zip_with(F.slice(d, 1, len(weights)), F.lit(weights), lambda a, w: a * w)
    return F.when(F.size(d) >= len(weights), total(products))


def digit(text: Column, at: int) -> Column:
    return F.substring(only(text), at + 1, 1).cast("int")


def luhn(text: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", only(text)), F.lit(False))


def mod97(text: Column) -> Column:
    """The ISO 7064 MOD 97-10 test of an IBAN: first four characters moved behind, letters as 10 to 35, remainder 1."""
    plain = F.upper(only(text, "0-9A-Za-z"))
    moved = F.filter(F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(moved, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return rest == 1


def iso7064_11_10(text: Column) -> Column:
    """MOD 11,10 over all digits but the last, which is the check digit."""
    d = digits(text)
    step = lambda p, x: F.when((p + x) % 10 == 0, 10).otherwise((p + x) % 10) * 2 % 11
    p = F.aggregate(F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0))), F.lit(10), step)
    return (11 - p) % 10 == F.element_at(d, -1)


def icao(text: Column) -> Column:
    """Weights 7, 3, 1 over all characters but the last (letters as 10 to 35), modulo 10, equal to the last."""
    chars = F.filter(F.split(F.upper(text), ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    body = F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0)))
    s = total(F.transform(body, lambda c, i: value(c) * F.element_at(F.lit([7, 3, 1]), i % 3 + 1)))
    return s % 10 == F.element_at(chars, -1).cast("int")


# The multiplication and permutation tables of the Verhoeff scheme.
VERHOEFF_D = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 0, 6, 7, 8, 9, 5], [2, 3, 4, 0, 1, 7, 8, 9, 5, 6], [3, 4, 0, 1, 2, 8, 9, 5, 6, 7], [4, 0, 1, 2, 3, 9, 5, 6, 7, 8], [5, 9, 8, 7, 6, 0, 4, 3, 2, 1], [6, 5, 9, 8, 7, 1, 0, 4, 3, 2], [7, 6, 5, 9, 8, 2, 1, 0, 4, 3], [8, 7, 6, 5, 9, 3, 2, 1, 0, 4], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]]
VERHOEFF_P = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [5, 8, 0, 3, 7, 9, 6, 1, 4, 2], [8, 9, 1, 6, 0, 4, 3, 5, 2, 7], [9, 4, 5, 3, 1, 2, 6, 8, 7, 0], [4, 2, 8, 6, 5, 7, 3, 9, 0, 1], [2, 7, 9, 3, 8, 0, 6, 4, 1, 5], [7, 0, 4, 6, 9, 1, 3, 2, 5, 8]]


def verhoeff(text: Column) -> Column:
    at = lambda table, i, j: F.element_at(F.element_at(F.lit(table), i + 1), j + 1)
    placed = F.transform(F.reverse(digits(text)), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.aggregate(placed, F.lit(0), lambda c, e: at(VERHOEFF_D, c, at(VERHOEFF_P, e["i"] % 8, e["x"]))) == 0


def cross_sums(text: Column, weights: list[int]) -> Column:
    """Sum over the first digits of tens plus units of digit times weight; null where there are fewer digits than weights."""
    d = digits(text)
    products = F.zip_with(F.slice(d, 1, len(weights)), F.lit(weights), lambda a, w: F.floor(a * w / 10).cast("int") + a * w % 10)
    return F.when(F.size(d) >= len(weights), total(products))


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
ADDRESS_BYTES = 25


def base58check(text: Column) -> Column:
    """A 25-byte address in base 58, whose last four bytes begin the twofold SHA-256 of the others.

    The number is held as 25 bytes, lowest first; each letter multiplies it by 58 and adds its value.
    """
    ranks = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(BASE58), c) - 1)

    def append(number: Column, rank: Column) -> Column:
        def carry(a: Column, byte: Column) -> Column:
            v = byte * 58 + a["over"]
            return F.struct(F.floor(v / 256).cast("int").alias("over"), F.concat(a["out"], F.array(v % 256)).alias("out"))

        start = F.struct(rank.cast("int").alias("over"), F.array().cast("array<int>").alias("out"))
        done = lambda a: F.struct(a["out"].alias("bytes"), (number["fits"] & (a["over"] == 0)).alias("fits"))
        return F.aggregate(number["bytes"], start, carry, done)

    zero = F.struct(F.array_repeat(F.lit(0), ADDRESS_BYTES).alias("bytes"), F.lit(True).alias("fits"))
    result = lambda n: F.struct(F.array_join(F.transform(F.reverse(n["bytes"]), lambda b: F.lpad(F.hex(b), 2, "0")), "").alias("hexes"), n["fits"].alias("fits"))
    number = F.aggregate(ranks, zero, append, result)

    def verdict(n: Column) -> Column:
        body, check = F.substring(n["hexes"], 1, 42), F.substring(n["hexes"], 43, 8)
        twofold = F.upper(F.substring(F.sha2(F.unhex(F.sha2(F.unhex(body), 256)), 256), 1, 8))
        zeros = F.length(F.regexp_extract(n["hexes"], "^((?:00)*)", 1)) == 2 * F.length(F.regexp_extract(text, "^(1*)", 1))
        return n["fits"] & zeros & (twofold == check)

    return F.when(text.rlike(f"^[{BASE58}]+$"), F.element_at(F.transform(F.array(number), verdict), 1)).otherwise(False)


def bech32(text: Column) -> Column:
    """A lower-case address that begins with bc1, whose BCH checksum is that of Bech32 (1) or Bech32m."""
    # The generator's coefficients and the two checksums.
    generator, good = [0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3], [1, 0x2BC830A3]
    data = F.transform(F.filter(F.split(F.substring(text, 4, 90), ""), lambda c: c != ""), lambda c: F.instr(F.lit(BECH32), c) - 1)

    def step(a: Column, v: Column) -> Column:
        top = F.shiftright(a, 25)
        out = F.shiftleft(a.bitwiseAND(F.lit(0x1FFFFFF).cast("long")), 5).bitwiseXOR(v.cast("long"))
        for i, g in enumerate(generator):
            out = out.bitwiseXOR(F.shiftright(top, i).bitwiseAND(F.lit(1).cast("long")) * F.lit(g).cast("long"))
        return out

    prefix = [3, 3, 0, 2, 3]  # "bc": the letters' high bits, 0, their low bits
    return F.when(text.rlike(f"^bc1[{BECH32}]{{7,}}$"), F.aggregate(F.concat(F.lit(prefix), data), F.lit(1).cast("long"), step).isin(good)).otherwise(False)
