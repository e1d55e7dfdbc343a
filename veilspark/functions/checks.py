"""Checksum predicates of identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's \s has it; \s of Java and of Python's re.ASCII is narrower (fixed values).
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check; the empty string does."""
    spread = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(F.filter(spread, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def iban(text: Column) -> Column:
    """True for 15 to 34 characters with two letters, two digits and remainder 1 modulo 97, spaces and case apart."""
    s = F.upper(F.regexp_replace(text, SPACE, ""))
    turned = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.when(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), F.aggregate(turned, F.lit(0), step) == 1).otherwise(False)


def aba(text: Column) -> Column:
    """True for nine digits with a weighted sum (3, 7, 1) that 10 divides and a prefix that is in use."""
    weight = F.array(*[F.lit(x) for x in (3, 7, 1) * 3])
    total = F.aggregate(F.zip_with(F.split(text, ""), weight, lambda c, w: c.try_cast("int") * w), F.lit(0), lambda a, x: a + x)
    prefix = F.substring(text, 1, 2).try_cast("int")
    used = (prefix <= 12) | prefix.between(21, 32) | prefix.between(61, 72) | (prefix == 80)
    return F.when(text.rlike("^[0-9]{9}$"), (total % 10 == 0) & used).otherwise(False)


CHECKS = {"luhn": luhn, "iban": iban, "aba": aba}


def iban_ok(text: str) -> bool:
    """iban() on one string, for the Arrow functions."""
    s = "".join(text.split()).upper()
    if not (15 <= len(s) <= 34 and s.isascii() and s.isalnum() and s[:2].isalpha() and s[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def luhn_ok(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def aba_ok(digits: str) -> bool:
    if not (len(digits) == 9 and digits.isascii() and digits.isdigit()):
        return False
    prefix = int(digits[:2])
    in_use = prefix <= 12 or 21 <= prefix <= 32 or 61 <= prefix <= 72 or prefix == 80
    return in_use and sum(int(d) * w for d, w in zip(digits, (3, 7, 1) * 3)) % 10 == 0
