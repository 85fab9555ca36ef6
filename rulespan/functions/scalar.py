"""Primitive functions as column expressions.

A partial function gives null where it has no result: in a query the match is dropped, in an action
the program fails. All guards come before the operation, since ANSI arithmetic raises. Functions are
found by name and the sorts of their arguments.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import reduce
from math import ceil, floor, isqrt

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN, MAX = -(2**63), 2**63 - 1
Function = Callable[..., Column]
#: (name, argument sorts) -> (function, result sort); "*" repeats the sort before it, "?" is any.
TABLE: dict[str, list[tuple[tuple[str, ...], Function, str]]] = {}
#: Sorts whose values take long to find: in a body, each is found once a match.
COSTLY = {"BigRat"}


def define(name: str, args: str, result: str, f: Function) -> None:
    TABLE.setdefault(name, []).append((tuple(args.split()), f, result))


def _fits(wanted: tuple[str, ...], given: list[str]) -> dict[str, str] | None:
    if wanted and wanted[-1] == "*":
        wanted = wanted[:-2] + (wanted[-2],) * (len(given) - len(wanted) + 2)
    if len(wanted) != len(given):
        return None
    bound: dict[str, str] = {}
    for w, g in zip(wanted, given, strict=True):
        if not _match(w, g, bound):
            return None
    return bound


def _match(w: str, g: str, bound: dict[str, str]) -> bool:
    """Whether a given sort fits a wanted one; "?" in the given one, of an empty container, fits anything."""
    if w[0] in "?$":
        if w == "?":
            return True
        bound[w] = both if (both := unified(bound.get(w, "?"), g)) else ""
        return both is not None
    if g == "?":
        return True
    if "<" in w:
        if "<" not in g or w.split("<", 1)[0] != g.split("<", 1)[0]:
            return False
        a, b = (split_args(x) for x in (w, g))
        return len(a) == len(b) and all(_match(x, y, bound) for x, y in zip(a, b, strict=True))
    return w == g


def unified(a: str, b: str) -> str | None:
    """The sort that both can be, where parts of either may be unknown; None if there is none."""
    if a == b or b == "?":
        return a
    if a == "?":
        return b
    if "?" not in a + b or "<" not in a or "<" not in b or a.split("<", 1)[0] != b.split("<", 1)[0]:
        return None
    parts = [unified(x, y) for x, y in zip(split_args(a), split_args(b), strict=True)]
    return None if None in parts else f"{a.split('<', 1)[0]}<{','.join(parts)}>"


def split_args(sort: str) -> list[str]:
    """``Map<A,Vec<B>>`` -> A, Vec<B>"""
    out, depth, now = [], 0, ""
    for c in sort.split("<", 1)[1][:-1]:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def find(name: str, sorts: list[str]) -> tuple[Function, str] | None:
    found = resolve(name, sorts)
    return found and found[:2]


def resolve(name: str, sorts: list[str]) -> tuple[Function, str, list[str]] | None:
    """Function, result sort, and the argument sorts with what is known of empty containers filled in."""
    for wanted, f, result in TABLE.get(name, []):
        bound = _fits(wanted, sorts)
        if bound is not None:
            wide = wanted[:-2] + (wanted[-2],) * (len(sorts) - len(wanted) + 2) if wanted and wanted[-1] == "*" else wanted
            filled = [_filled(w, bound) if w != "?" else g for w, g in zip(wide, sorts, strict=True)]
            return f, _filled(result, bound), filled
    return None


def _filled(sort: str, bound: dict[str, str]) -> str:
    for k, v in bound.items():
        sort = sort.replace(k, v)
    return sort


def _true(x: Column) -> Column:
    """A relation as a partial function without value."""
    return F.when(x, F.lit(True))


def _fold(f: Function) -> Function:
    return lambda *xs: reduce(f, xs)


for sort in ("i64", "f64"):
    for name, f in {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}.items():
        define(name, f"{sort} {sort}", "Unit", lambda a, b, f=f: _true(f(a, b)))
        if sort == "i64":
            define(f"bool-{name}", "i64 i64", "bool", f)
    define("min", f"{sort} {sort} *", sort, lambda *xs: F.least(*xs) if len(xs) > 1 else xs[0])
    define("max", f"{sort} {sort} *", sort, lambda *xs: F.greatest(*xs) if len(xs) > 1 else xs[0])
define("bool-=", "i64 i64", "bool", lambda a, b: a == b)
#: The lesser and greater by what stands for a value inside: of ids, the older and the newer name.
define("ordering-min", "$a $a", "$a", F.least)
define("ordering-max", "$a $a", "$a", F.greatest)
define("!=", "$a $a", "Unit", lambda a, b: _true(a != b))
define("bool-!=", "$a $a", "bool", lambda a, b: a != b)

define("+", "i64 i64 *", "i64", _fold(F.try_add))
define("-", "i64 i64", "i64", F.try_subtract)
define("*", "i64 i64 *", "i64", _fold(F.try_multiply))
define("/", "i64 i64", "i64", lambda a, b: _div(a, b))
define("%", "i64 i64", "i64", lambda a, b: F.when((b != 0) & (b != -1), F.try_mod(a, b)).when((b == -1) & (a != MIN), F.lit(0).cast("long")))
define("&", "i64 i64", "i64", lambda a, b: a.bitwiseAND(b))
define("|", "i64 i64", "i64", lambda a, b: a.bitwiseOR(b))
define("^", "i64 i64", "i64", lambda a, b: a.bitwiseXOR(b))
define("<<", "i64 i64", "i64", lambda a, b: F.when(b.between(0, 63), F.call_function("shiftleft", a, F.pmod(b, F.lit(64)).cast("int"))))
define(">>", "i64 i64", "i64", lambda a, b: F.when(b.between(0, 63), F.call_function("shiftright", a, F.pmod(b, F.lit(64)).cast("int"))))
define("not-i64", "i64", "i64", F.bitwise_not)
define("log2", "i64", "i64", lambda x: F.when(x > 0, (F.length(F.bin(x)) - 1).cast("long")))
define("abs", "i64", "i64", lambda x: F.when(x != MIN, F.abs(F.when(x != MIN, x))))
define("to-string", "i64", "String", lambda x: x.cast("string"))
define("to-f64", "i64", "f64", lambda x: x.cast("double"))


def _div(a: Column, b: Column) -> Column:
    """Truncating; both sides are made safe first, for Spark may evaluate either branch."""
    ok = (b != 0) & ~((a == MIN) & (b == -1))

    return F.when(ok, F.call_function("div", F.when(ok, a), F.when(ok, b)))



for name, f in {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}.items():
    define(name, "f64 f64", "f64", f)
define("/", "f64 f64", "f64", lambda a, b: F.try_divide(a, b))
define("%", "f64 f64", "f64", lambda a, b: F.when(b != 0, F.try_mod(a, b)))
define("^", "f64 f64", "f64", lambda a, b: F.pow(a, b))
define("neg", "f64", "f64", F.negative)
define("abs", "f64", "f64", F.abs)
define("to-i64", "f64", "i64", lambda x: F.when(F.isnan(x), F.lit(0).cast("long")).when(x >= 2.0**63, F.lit(MAX)).when(x <= -(2.0**63), F.lit(MIN)).otherwise(x.try_cast("long")))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value found once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _shown(x: Column) -> Column:
    """Shortest digits that read back; an exponent from 1e16 up and under 1e-4 only."""

    def written(p: Column) -> Column:
        """Of sign, digits without a point, and the power of ten of the first of them."""
        e, digits, n = p["e"], p["digits"], F.length(p["digits"])
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-e - 1, F.lit(0))), digits)
        large = F.concat(F.substring(F.rpad(digits, e + 1, "0"), F.lit(1), e + 1), F.lit("."), F.when(n > e + 1, F.substring(digits, e + 2, n)).otherwise("0"))
        power = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), e.cast("string"))
        return F.concat(p["sign"], F.when((e >= 16) | (e < -4), power).when(e >= 0, large).otherwise(small))

    def by_parts(p: Column) -> Column:
        digits = F.regexp_replace(F.translate(F.get(p, F.lit(0)), "-.", ""), "(?<=.)0+$", "")
        parts = F.struct(F.when(F.startswith(F.get(p, F.lit(0)), F.lit("-")), "-").otherwise("").alias("sign"), digits.alias("digits"), F.get(p, F.lit(1)).try_cast("int").alias("e"))
        return F.when(F.size(p) == 1, F.get(p, F.lit(0))).otherwise(_once(parts, written))

    # Infinities are written otherwise; all else comes as digits, and a power of ten where it is large or small.
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(_once(F.split(x.cast("string"), "E"), by_parts))


define("to-string", "f64", "String", _shown)

define("not", "bool", "bool", lambda a: ~a)
define("and", "bool bool *", "bool", _fold(lambda a, b: a & b))
define("or", "bool bool *", "bool", _fold(lambda a, b: a | b))
define("xor", "bool bool", "bool", lambda a, b: a != b)
define("=>", "bool bool", "bool", lambda a, b: ~a | b)
define("guard", "bool", "Unit", _true)

define("+", "String String *", "String", lambda *xs: F.concat(*xs))
define("replace", "String String String", "String", lambda a, b, c: F.replace(a, b, c))
define("count-matches", "String String", "i64", lambda a, b: F.when(b == "", F.length(a) + 1).otherwise((F.length(a) - F.length(F.replace(a, b, F.lit("")))) / F.greatest(F.length(b), F.lit(1))).cast("long"))

# Whole numbers of up to 38 digits; what has more has no result.


def _exact(f: Callable[..., object]) -> Function:
    """Python's own whole numbers, in Arrow batches, for what decimals can't express; None is no result."""

    def batch(*cols: pa.Array) -> pa.Array:
        out = [None if any(x is None for x in row) else f(*row) for row in zip(*(c.to_pylist() for c in cols), strict=True)]
        return pa.array([None if x is None else str(x) for x in out], pa.string())

    # Made when it is used: without a session there are no user functions.
    return lambda *cols: F.arrow_udf(batch, "string")(*cols)


def _whole(f: Callable[..., int | None]) -> Function:
    exact = _exact(lambda *xs: f(*map(int, xs)))
    return lambda *cols: exact(*[c.cast("string") for c in cols]).try_cast("decimal(38,0)")


for name, f in {"&": lambda a, b: a & b, "|": lambda a, b: a | b, "^": lambda a, b: a ^ b}.items():
    define(name, "BigInt BigInt", "BigInt", _whole(f))
# Shifts by more than a number can have bits are left without a result before they are made.
define("<<", "BigInt i64", "BigInt", _whole(lambda a, n: a << n if 0 <= n < 256 else None))
define(">>", "BigInt i64", "BigInt", _whole(lambda a, n: a >> n if n >= 0 else None))
define("not-Z", "BigInt", "BigInt", _whole(lambda a: ~a))
define("bits", "BigInt", "BigInt", _whole(lambda a: a.bit_length()))
define("bigint", "i64", "BigInt", lambda x: x.cast("decimal(38,0)"))
for name, f in {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}.items():
    define(name, "BigInt BigInt", "BigInt", lambda a, b, f=f: f(a, b).cast("decimal(38,0)"))
define("/", "BigInt BigInt", "BigInt", lambda a, b: F.when(b != 0, F.call_function("div", a, F.when(b != 0, b))).cast("decimal(38,0)"))
define("%", "BigInt BigInt", "BigInt", lambda a, b: F.when(b != 0, F.try_mod(a, b)).cast("decimal(38,0)"))
for name, f in {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}.items():
    define(name, "BigInt BigInt", "Unit", lambda a, b, f=f: _true(f(a, b)))
    define(f"bool-{name}", "BigInt BigInt", "bool", f)
define("bool-=", "BigInt BigInt", "bool", lambda a, b: a == b)
define("min", "BigInt BigInt", "BigInt", F.least)
define("max", "BigInt BigInt", "BigInt", F.greatest)
define("to-string", "BigInt", "String", lambda x: x.cast("string"))
define("from-string", "String", "BigInt", lambda x: x.try_cast("decimal(38,0)"))

# Rationals: struct<num,den>, reduced by Euclid's algorithm in SQL.

WIDE = "decimal(38,0)"
#: Numbers up to it are reduced as 64-bit ones.
NARROW = 10**18


def _with_gcd(a: Column, b: Column, of: str, f: Callable[[Column], Column]) -> Column:
    """``f`` of the greatest common divisor. By Lamé, a lesser number x takes no more than 1 + log(x) steps, to the base of the golden ratio."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).cast(of).alias("b")))
    a, b = F.abs(a), F.abs(b)
    steps = F.floor(F.log(F.greatest(F.least(a, b), F.lit(1).cast(of)).cast("double")) * 2.0781 + 1).cast("int")
    start = F.struct(F.greatest(a, b).cast(of).alias("a"), F.least(a, b).cast(of).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: f(s["a"]))


def _part(n: Column, g: Column) -> Column:
    """``n / g`` where ``g`` divides ``n``: ``div`` gives 64 bits only, and a quotient of decimals 32 whole digits."""
    tens = F.lit(10**18).cast(WIDE)
    whole = lambda a, b: (a / b).cast(WIDE)
    low = (n % tens).cast(WIDE)
    high = whole((n - low).cast(WIDE), tens)
    over = (high % g).cast(WIDE)
    by_halves = (whole((high - over).cast(WIDE), g) * tens + whole((over * tens + low).cast(WIDE), g)).cast(WIDE)
    return F.when(g == 1, n).when(g >= 10**6, whole(n, g)).otherwise(by_halves)


def _ratio(n: Column, d: Column) -> Column:
    # Functions within functions are avoided: Python's can't take them as arguments.
    def by(n: Column, d: Column, of: str, part: Function) -> Column:
        signed = lambda x, g: part(F.when(d < 0, -x).otherwise(x).cast(of), g).cast(WIDE)
        return _with_gcd(n, d, of, lambda g: F.struct(signed(n, g).alias("num"), signed(d, g).alias("den")))

    short = [x.try_cast("long") for x in (n, d)]
    narrow = short[0].between(-NARROW, NARROW) & short[1].between(-NARROW, NARROW) & (short[1] != 0)
    return F.when(narrow, by(*short, "long", lambda a, g: F.call_function("div", a, g))).when((d != 0) & n.isNotNull(), by(n, d, WIDE, _part))


define("bigrat", "BigInt BigInt", "BigRat", _ratio)
define("+", "BigRat BigRat", "BigRat", lambda a, b: _ratio((a["num"] * b["den"] + b["num"] * a["den"]).cast("decimal(38,0)"), (a["den"] * b["den"]).cast("decimal(38,0)")))
define("-", "BigRat BigRat", "BigRat", lambda a, b: _ratio((a["num"] * b["den"] - b["num"] * a["den"]).cast("decimal(38,0)"), (a["den"] * b["den"]).cast("decimal(38,0)")))
define("*", "BigRat BigRat", "BigRat", lambda a, b: _ratio((a["num"] * b["num"]).cast("decimal(38,0)"), (a["den"] * b["den"]).cast("decimal(38,0)")))
define("/", "BigRat BigRat", "BigRat", lambda a, b: _ratio((a["num"] * b["den"]).cast("decimal(38,0)"), (a["den"] * b["num"]).cast("decimal(38,0)")))
define("neg", "BigRat", "BigRat", lambda a: F.struct((-a["num"]).cast("decimal(38,0)").alias("num"), a["den"].alias("den")))
define("abs", "BigRat", "BigRat", lambda a: F.struct(F.abs(a["num"]).cast("decimal(38,0)").alias("num"), a["den"].alias("den")))
define("numer", "BigRat", "BigInt", lambda a: a["num"])
define("denom", "BigRat", "BigInt", lambda a: a["den"])
define("to-f64", "BigRat", "f64", lambda a: a["num"].cast("double") / a["den"].cast("double"))
for name, f in {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}.items():
    define(name, "BigRat BigRat", "Unit", lambda a, b, f=f: _true(f(a["num"] * b["den"], b["num"] * a["den"])))

_less = lambda a, b: a["num"] * b["den"] <= b["num"] * a["den"]
define("min", "BigRat BigRat", "BigRat", lambda a, b: F.when(_less(a, b), a).otherwise(b))
define("max", "BigRat BigRat", "BigRat", lambda a, b: F.when(_less(a, b), b).otherwise(a))


def _rational(f: Callable[[Fraction], Fraction | None]) -> Function:
    """A function of fractions, exact; numbers beyond 38 digits have no result."""

    def on(*parts: str) -> str | None:
        out = f(*[Fraction(int(n), int(d)) for n, d in zip(parts[::2], parts[1::2], strict=True)])
        return None if out is None else f"{out.numerator}/{out.denominator}"

    exact = _exact(on)

    def column(*cols: Column) -> Column:
        text = exact(*[c[k].cast("string") for c in cols for k in ("num", "den")])
        n, d = (F.split_part(text, F.lit("/"), F.lit(k)).try_cast("decimal(38,0)") for k in (1, 2))
        return F.when(n.isNotNull() & d.isNotNull(), F.struct(n.alias("num"), d.alias("den")))

    return column


def _power(a: Fraction, b: Fraction) -> Fraction | None:
    """Whole exponents only; 0 to a negative power has no result."""
    if b.denominator != 1 or abs(b) > 4096 or not a and b < 0:
        return None
    return a ** int(b)


def _root(a: Fraction) -> Fraction | None:
    """Of squares of positive rationals only."""
    n, d = isqrt(max(a.numerator, 0)), isqrt(a.denominator)
    return Fraction(n, d) if a > 0 and n * n == a.numerator and d * d == a.denominator else None


define("floor", "BigRat", "BigRat", _rational(lambda a: Fraction(floor(a))))
define("ceil", "BigRat", "BigRat", _rational(lambda a: Fraction(ceil(a))))
#: Halves go away from zero.
define("round", "BigRat", "BigRat", _rational(lambda a: Fraction(floor(abs(a) + Fraction(1, 2)) * (1 if a >= 0 else -1))))
define("pow", "BigRat BigRat", "BigRat", _rational(_power))
define("sqrt", "BigRat", "BigRat", _rational(_root))
#: Only 1 has an exact logarithm, and of cube roots only that of 1 is given.
define("log", "BigRat", "BigRat", _rational(lambda a: Fraction(0) if a == 1 else None))
define("cbrt", "BigRat", "BigRat", _rational(lambda a: Fraction(1) if a == 1 else None))
