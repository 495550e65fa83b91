"""Scalar functions on strings, bytes and bits."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_, xor

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(x: Column, f) -> Column:
    """f of x with x evaluated once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(x), f), 0)


def glob_regex(pattern: str) -> str:
    """Java regex for a byte glob: * ? [..] and backslash escapes."""
    out, i = ["(?s)^"], 0
    quote = lambda c: "\\" + c if not (c.isalnum() or c in " _" or ord(c) > 127) else c
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(quote(pattern[i]))
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            negate = body.startswith("^")
            parts = "".join(x if x == "-" else quote(x) for x in body[negate:])
            out.append(f"[{'^' if negate else ''}{parts}]")
            i = end
        else:
            out.append(quote(c))
        i += 1
    return "".join(out) + "$"


def glob(c: Column | str, pattern: str) -> Column:
    return col(c).rlike(glob_regex(pattern))


def byte_length(c: Column | str) -> Column:
    return F.octet_length(col(c))


def byte_range(c: Column | str, start: int, stop: int) -> Column:
    """Inclusive byte substring; negative indexes count from the end and are clamped."""
    b = col(c).cast("binary")
    n = F.octet_length(b)
    at = F.greatest(F.lit(0), F.lit(start) if start >= 0 else n + start)
    to = F.least(n - 1, F.lit(stop) if stop >= 0 else n + stop)
    return F.when((at > to) | (n == 0), F.lit("")).otherwise(F.substring(b, at + 1, to - at + 1).cast("string"))


def set_range(c: Column | str, offset: int, patch: str) -> Column:
    """Overwrites bytes from offset on, padding with zero bytes."""
    b = F.coalesce(col(c), F.lit("")).cast("binary")
    pad = F.rpad(b, offset, F.lit(bytearray(b"\0"))) if offset else F.lit(bytearray())
    head = F.when(F.octet_length(b) >= offset, F.substring(b, 1, offset)).otherwise(pad)
    tail = F.substring(b, offset + len(patch.encode()) + 1, 1 << 30)
    return F.concat(head, F.lit(bytearray(patch.encode())), tail).cast("string")


def bytes_of(c: Column | str) -> Column:
    """Bytes as an array of numbers 0 to 255."""
    b = col(c).cast("binary")
    chars = F.split(F.decode(b, "ISO-8859-1"), "")  # one a byte, with the byte's number
    return F.when(F.octet_length(b) > 0, F.transform(chars, F.ascii)).otherwise(F.array().cast("array<int>"))


def get_bit(c: Column | str, offset: int) -> Column:
    """Bit at a big-endian offset; beyond the end 0."""
    byte = F.get(bytes_of(c), offset // 8)
    return F.coalesce(F.shiftright(byte, 7 - offset % 8).bitwiseAND(1), F.lit(0))


def bit_count(c: Column | str, start: int = 0, stop: int = -1) -> Column:
    """Set bits in an inclusive byte range."""
    b = bytes_of(c)
    n = F.size(b)
    at = F.greatest(F.lit(0), F.lit(start) if start >= 0 else n + start)
    to = F.least(n - 1, F.lit(stop) if stop >= 0 else n + stop)
    part = F.when(at <= to, F.slice(b, at + 1, to - at + 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(part, F.lit(0), lambda a, x: a + F.bit_count(x))


def bit_position(c: Column | str, target: int) -> Column:
    """First bit equal to target; a text of ones alone has its first zero just behind it; none: -1."""
    b = bytes_of(c)
    bits = F.flatten(F.transform(b, lambda x: F.transform(F.sequence(F.lit(7), F.lit(0)), lambda k: F.call_function("shiftright", x, k).bitwiseAND(1))))
    at = (F.array_position(bits, F.lit(target)) - 1).cast("int")
    return F.when((at < 0) & (F.size(b) > 0), F.size(bits)).otherwise(at) if target == 0 else at


def _bit_op(op: str, *cs: bytes | None) -> str:
    """The strings as one number each, so that an operation is one step whatever their length."""
    n = max(len(c or b"") for c in cs)
    first, *rest = [int.from_bytes((c or b"").ljust(n, b"\0"), "big") for c in cs]
    if op == "NOT":
        out = first ^ ((1 << 8 * n) - 1)
    elif op == "AND":
        out = reduce(and_, rest, first)
    elif op == "OR":
        out = reduce(or_, rest, first)
    elif op == "XOR":
        out = reduce(xor, rest, first)
    elif op == "DIFF":
        out = first & ~reduce(or_, rest)
    elif op == "DIFF1":
        out = reduce(or_, rest) & ~first
    elif op == "ANDOR":
        out = first & reduce(or_, rest)
    else:
        seen, twice = first, 0
        for x in rest:
            seen, twice = seen | x, twice | (seen & x)
        out = seen & ~twice
    return out.to_bytes(n, "big").hex().upper()


def bit_op(op: str, *cs: Column | str) -> Column:
    """AND, OR, XOR, NOT, DIFF, DIFF1, ANDOR, ONE over strings padded with zeros to the longest, as hex. In Arrow batches."""
    if op not in ("AND", "OR", "XOR", "NOT", "DIFF", "DIFF1", "ANDOR", "ONE"):
        raise ValueError(op)
    cs = cs[:1] if op == "NOT" else cs
    return F.udf(lambda *xs: _bit_op(op, *xs), "string", useArrow=True)(*[col(c).cast("binary") for c in cs])


def infer_kind(c: Column | str) -> Column:
    """bool, int64, uint64, float64 or string of a text, by its canonical form."""
    x = col(c)
    whole = x.rlike("^(0|-?[1-9][0-9]{0,19})$")
    return (
        F.when(x.isin("true", "false"), "bool")
        .when(whole & x.try_cast("bigint").isNotNull(), "int64")
        .when(whole & x.try_cast("decimal(20,0)").between(F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit("18446744073709551615").cast("decimal(20,0)")), "uint64")
        .when(x.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?(e[+-][0-9]{2,3})?$") & x.try_cast("double").isNotNull(), "float64")
        .otherwise("string")
    )


def tokens(c: Column | str) -> Column:
    """Maximal runs of letters, digits and underscores, lowered."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{Nd}_]+"), lambda x: x != "")


def within_edits(a: Column, b: Column, most: int, bytewise: bool = False) -> Column:
    """Whether at most so many edits of characters, or of their UTF-8 bytes, part a and b."""
    if not bytewise:
        return F.levenshtein(a, b, most) >= 0
    one_each = (F.octet_length(a) == F.char_length(a)) & (F.octet_length(b) == F.char_length(b))
    latin = lambda c: F.decode(c.cast("binary"), "ISO-8859-1")  # noqa: E731  one character a byte
    return F.levenshtein(F.when(one_each, a).otherwise(latin(a)), F.when(one_each, b).otherwise(latin(b)), most) >= 0


def _lcs(a: str | None, b: str | None) -> str | None:
    if a is None or b is None:
        return None
    n = len(b)
    rows = [[0] * (n + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(a), n
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif rows[i - 1][j] > rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return "".join(reversed(out))


def lcs(a: Column | str, b: Column | str) -> Column:
    """Longest common subsequence."""
    return F.udf(_lcs, "string", useArrow=True)(col(a), col(b))
