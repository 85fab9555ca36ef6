"""Containers of ids, function values, merges that make rows, and number functions."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rulespan.operators.program import Program


def ok(spark, text):
    p = Program(spark)
    return p, p.run(text)


def test_empty_containers(spark):
    p, _ = ok(
        spark,
        """(sort Vs (Vec i64)) (sort Ss (Set String)) (sort Ms (Map String i64)) (sort Vv (Vec Vs))
        (relation v (Vs)) (relation s (Ss)) (relation m (Ms)) (relation vv (Vv))
        (v (vec-empty)) (s (set-empty)) (m (map-insert (map-empty) "a" 1)) (m (map-empty)) (vv (vec-push (vec-empty) (vec-of 1)))
        (let e (vec-push (vec-empty) 3))
        (check (v (vec-empty))) (check (v x) (= 0 (vec-length x))) (check (s (set-empty))) (check (m (map-insert (map-empty) "a" 1)))
        (check (= e (vec-of 3))) (check (= (vec-of) (vec-empty))) (fail (check (m (map-insert (map-empty) "a" 2))))
        (relation n (i64)) (n 5) (relation out (Vs)) (rule ((n x) (= y (vec-push (vec-empty) x))) ((out y) (out (vec-append y (vec-empty))))) (run 1) (check (out (vec-of 5)))""",
    )
    assert p.size("out") == 1 and p.size("m") == 2


CONTAINERS = [
    ("(Vec Item)", "(vec-of (L 1) (L 5))", "(vec-of (L 2) (L 5))"),
    ("(Set Item)", "(set-of (L 1) (L 2) (L 3))", "(set-of (L 2) (L 3))"),
    ("(Map Item i64)", "(map-insert (map-empty) (L 1) 7)", "(map-insert (map-empty) (L 2) 7)"),
    ("(Map i64 Item)", "(map-insert (map-empty) 7 (L 1))", "(map-insert (map-empty) 7 (L 2))"),
    ("(MultiSet Item)", "(multiset-of (L 1) (L 2))", "(multiset-of (L 2) (L 2))"),
    ("(Pair Item i64)", "(pair (L 1) 4)", "(pair (L 2) 4)"),
    ("(Vec Inner)", "(vec-of (vec-of (L 1)) (vec-of (L 3)))", "(vec-of (vec-of (L 2)) (vec-of (L 3)))"),
]


def test_ids_in_containers_follow_unions(spark):
    """Of any kind, as arguments and values, and one level up: rows over containers that become equal collide."""
    declare, before, after = "", "", ""
    for k, (sort, a, b) in enumerate(CONTAINERS):
        declare += f"(sort B{k} {sort}) (constructor Wrap{k} (B{k}) Item) (relation has{k} (B{k} Item)) (function of{k} (i64) B{k} :merge new)"
        before += f"(has{k} {a} (Wrap{k} {a})) (has{k} {b} (Wrap{k} {b})) (set (of{k} 1) {a})"
        after += f"(= (of{k} 1) {b}) (has{k} {b} (Wrap{k} {a}))"
    p, _ = ok(spark, f"(sort Item) (constructor L (i64) Item) (sort Inner (Vec Item)) {declare}")
    effects = f"(rule () ({before}))"
    p.run(f"{effects} (run 1)")
    assert all(p.size(f"Wrap{k}") == 2 and p.size(f"has{k}") == 2 for k in range(len(CONTAINERS)))
    p.run(f"(fail (check (= (L 1) (L 2)))) (union (L 1) (L 2)) (check {after})")
    assert all(p.size(f"Wrap{k}") == 1 and p.size(f"has{k}") == 1 for k in range(len(CONTAINERS)))


def test_containers_that_change_are_seen_by_rules(spark):
    ok(
        spark,
        """(sort Item) (constructor L (i64) Item) (sort Items (Vec Item)) (relation has (Items)) (relation both (Items)) (relation done (i64))
        (has (vec-of (L 1))) (has (vec-of (L 2))) (both (vec-of (L 2))) (rule ((has v) (both v) (= v (vec-of (L 1)))) ((done 1)))
        (run 2) (fail (check (done 1))) (union (L 1) (L 2)) (run 2) (check (done 1))""",
    )


def test_merges_that_make_rows(spark):
    text = """(datatype Part (P i64)) (datatype Tree (Leaf Part) (Both Tree Tree) (Twice Tree))
        (function f (i64) Tree :merge (Both (Twice old) (Twice new))) (rewrite (Both a b) (Both b a))"""
    p, _ = ok(spark, text + "(set (f 0) (Leaf (P 1))) (run 1) (set (f 0) (Leaf (P 1))) (check (= (f 0) (Leaf (P 1)))) (set (f 0) (Leaf (P 2))) (run 2) (check (= (f 0) (Both (Twice (Leaf (P 1))) (Twice (Leaf (P 2))))))")
    assert p.size("Both") == 2 and p.size("Twice") == 2
    # Three values in one step.
    p, _ = ok(spark, text + "(relation v (i64)) (rule ((v x)) ((set (f 7) (Leaf (P x))))) (v 1) (v 2) (v 3) (v 3) (run 1) (check (= (f 7) (Both (Twice (Both (Twice a) (Twice b))) (Twice c))))")
    assert p.size("f") == 1
    # After ids become equal, rows over them merge too.
    ok(spark, text.replace("f (i64)", "f (Part)") + "(set (f (P 1)) (Leaf (P 5))) (set (f (P 2)) (Leaf (P 6))) (union (P 1) (P 2)) (check (= (f (P 1)) (Both (Twice x) (Twice y))))")


def test_merge_constants_and_no_merge(spark):
    ok(spark, "(function c (i64) i64 :merge 9) (set (c 1) 2) (check (= (c 1) 2)) (set (c 1) 3) (check (= (c 1) 9))")
    ok(spark, "(function s (i64) i64 :merge (+ old new)) (relation r (i64 i64)) (rule ((r k v)) ((set (s k) v))) (r 1 5) (r 1 6) (r 2 1) (run 1) (check (= (s 1) 11)) (check (= (s 2) 1))")


def test_function_values(spark):
    text = """(datatype Term (Num i64) (Plus Term Term) (Times Term Term)) (rewrite (Times (Num x) (Num y)) (Num (* x y)))
        (datatype Row (End) (Next Term Row)) (sort OnTerm (UnstableFn (Term) Term)) (constructor twice (Term) Term) (rewrite (twice x) (Plus x x))
        (constructor each (Row OnTerm) Row) (rewrite (each (End) f) (End)) (rewrite (each (Next x r) f) (Next (unstable-app f x) (each r f)))
        (constructor scaled (Row Term) Row) (rewrite (scaled r k) (each r (unstable-fn "Times" k)))"""
    ok(
        spark,
        text
        + """(let t (unstable-fn "twice")) (let a (unstable-app t (Num 4))) (check (= a (twice (Num 4))))
        (let row (Next (Num 2) (Next (Num 5) (End)))) (let both (each row t)) (let big (scaled row (Num 3)))
        (run 4) (check (= both (Next (twice (Num 2)) (Next (twice (Num 5)) (End))))) (check (= big (Next (Num 6) (Next (Num 15) (End)))))""",
    )
    # Of primitives, with arguments given; and functions of functions.
    ok(
        spark,
        """(sort OnNumber (UnstableFn (i64) i64)) (relation use (OnNumber i64)) (relation got (i64)) (rule ((use f x)) ((got (unstable-app f x))))
        (use (unstable-fn "*" 3) 5) (use (unstable-fn "+" 100) 1) (run 1) (check (got 15)) (check (got 101))
        (sort Item) (constructor I (i64) Item) (constructor after (OnNumber OnNumber i64) Item) (rewrite (after f g x) (I (unstable-app f (unstable-app g x))))
        (let r (after (unstable-fn "+" 1) (unstable-fn "*" 2) 10)) (run 1) (check (= r (I 21)))""",
    )
    # What a function was given follows unions.
    ok(spark, '(sort Item) (constructor I (i64) Item) (constructor Two (Item Item) Item) (sort Fn (UnstableFn (Item) Item)) (relation keep (Fn)) (keep (unstable-fn "Two" (I 1))) (let f (unstable-fn "Two" (I 2))) (fail (check (keep f))) (union (I 1) (I 2)) (check (keep f))')


@pytest.mark.parametrize("text", ['(sort F (UnstableFn (i64) String)) (relation r (F)) (r (unstable-fn "+" 1))', '(unstable-app (unstable-fn "nothing") 1)', '(sort F (UnstableFn (i64) i64)) (relation r (F)) (r (unstable-fn "+" "a"))'])
def test_function_values_are_typed(spark, text):
    with pytest.raises(Exception, match="unstable-fn"):
        ok(spark, text)


def test_functions_over_containers(spark):
    text = """(sort Numbers (Vec i64)) (sort Bag (MultiSet i64)) (sort Bags (MultiSet Bag)) (function sq (i64) i64 :no-merge) (set (sq 1) 1) (set (sq 2) 4) (set (sq 3) 4)
        (function split (i64) Bag :no-merge) (set (split 4) (multiset-of 2 2)) (sort Item) (constructor I (i64) Item) (sort Items (MultiSet Item)) (sort Ivec (Vec Item)) (constructor Join (Item Item) Item)"""
    p, _ = ok(
        spark,
        text
        + """
        (let a (unstable-vec-map (unstable-fn "sq") (vec-of 3 1 9 2))) (check (= a (vec-of 4 1 4)))
        (let b (unstable-multiset-map (unstable-fn "sq") (multiset-of 2 3 3 1))) (check (= b (multiset-of 4 4 4 1)))
        (let c (unstable-multiset-flat-map (unstable-fn "split") (multiset-of 4 4 7))) (check (= c (multiset-of 2 2 2 2 7)))
        (let d (unstable-multiset-filter (unstable-fn "sq") (multiset-of 1 1 8))) (check (= d (multiset-of 1 1)))
        (let e (unstable-multiset-filter-not (unstable-fn "sq") (multiset-of 1 1 8))) (check (= e (multiset-of 8)))
        (let f (unstable-multiset-reduce (unstable-fn "+") 100 (multiset-of 1 2 2))) (check (= f 5))
        (let g (unstable-multiset-reduce (unstable-fn "+") 100 (multiset-of))) (check (= g 100))
        (let h (multiset-sum-multisets (multiset-of (multiset-of 1 2) (multiset-of 1 2) (multiset-of 2)))) (check (= h (multiset-of 1 1 2 2 2)))
        (let i (unstable-multiset-map (unstable-fn "I") (multiset-of 1 1 2))) (check (= i (multiset-of (I 1) (I 1) (I 2))))
        (let j (unstable-multiset-reduce (unstable-fn "Join") (I 0) (multiset-of (I 1) (I 2) (I 3)))) (check (= j (Join (Join x y) z)))
        (vec-union (vec-of (I 1) (I 2)) (vec-of (I 11) (I 12))) (check (= (I 1) (I 11))) (check (= (I 2) (I 12))) (fail (check (= (I 1) (I 2))))
        (multiset-union-values (multiset-of (I 21) (I 22) (I 23))) (check (= (I 21) (I 22) (I 23)))
        (fail (vec-union (vec-of (I 1)) (vec-of)))""",
    )
    p, _ = ok(spark, text + '(function index (Bag i64) i64 :no-merge) (unstable-multiset-fill-index (multiset-of 5 5 6) (unstable-fn "index")) (check (= 2 (index (multiset-of 5 5 6) 5))) (check (= 1 (index (multiset-of 5 5 6) 6))) (unstable-multiset-fill-index (multiset-of 5 5 6) (unstable-fn "index"))')
    assert p.size("index") == 2
    p.run('(unstable-multiset-clear-index (multiset-of 5 5 6) (unstable-fn "index"))')
    assert p.size("index") == 0


def shown(x: float) -> str:
    """Shortest digits; powers from 1e16 and under 1e-4."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "inf" if x > 0 else "-inf"
    sign, digits, e = __import__("decimal").Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    e = e + len(digits) - 1 if any(digits) else 0
    lead = "-" if sign else ""
    if x and (e >= 16 or e < -4):
        return f"{lead}{text[0]}{'.' + text[1:] if text[1:] else ''}e{e}"
    if e < 0:
        return f"{lead}0.{'0' * (-e - 1)}{text}"
    text = text.ljust(e + 1, "0")
    return f"{lead}{text[: e + 1]}.{text[e + 1 :] or '0'}"


def test_f64_to_string(spark):
    values = [0.0, -0.0, 1.0, -2.5, 1234567890.5, 12345678.25, 0.0002, 0.0001, 0.00009999, 1e15, 1e16, 1.5e16, 123456789012345680.0, 9007199254740993.0, 1e-7, 2.5e-310, 1.7976931348623157e308, 0.1, 1 / 3, 1e7, 1e6, 100.0, float("nan"), float("inf"), float("-inf")]
    from rulespan.functions import scalar

    f = scalar.find("to-string", ["f64"])[0]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in frame.select(f(frame["x"])).collect()]
    assert got == [shown(v) for v in values]


def test_big_numbers(spark):
    text = lambda e: f'(to-string {e})'
    cases = {
        "(& (bigint 12) (bigint 10))": 8, "(| (bigint 12) (bigint 3))": 15, "(^ (bigint -1) (bigint 5))": -6, "(<< (bigint 3) 70)": 3 << 70, "(>> (bigint -9) 1)": -5, "(not-Z (bigint 5))": -6, "(bits (bigint 255))": 8,
    }
    ratio = {
        ("(floor (bigrat (bigint -7) (bigint 2)))"): Fraction(-4), "(ceil (bigrat (bigint -7) (bigint 2)))": Fraction(-3), "(round (bigrat (bigint -7) (bigint 2)))": Fraction(-4), "(round (bigrat (bigint 5) (bigint 4)))": Fraction(1),
        "(pow (bigrat (bigint 2) (bigint 3)) (bigrat (bigint -3) (bigint 1)))": Fraction(27, 8), "(sqrt (bigrat (bigint 9) (bigint 4)))": Fraction(3, 2), "(log (bigrat (bigint 1) (bigint 1)))": Fraction(0), "(cbrt (bigrat (bigint 1) (bigint 1)))": Fraction(1),
        "(min (bigrat (bigint 1) (bigint 2)) (bigrat (bigint 1) (bigint 3)))": Fraction(1, 3), "(max (bigrat (bigint 1) (bigint 2)) (bigrat (bigint 1) (bigint 3)))": Fraction(1, 2),
    }
    facts = " ".join([f'(r {k} {text(e)} "")' for k, e in enumerate(cases)] + [f"(r {100 + k} {text(f'(numer {e})')} {text(f'(denom {e})')})" for k, e in enumerate(ratio)])
    p, _ = ok(spark, f"(relation r (i64 String String)) {facts}")
    got = {r[0]: r[1:] for r in p.rows("r").collect()}
    assert [int(got[k][0]) for k in range(len(cases))] == list(cases.values())
    assert [Fraction(int(got[100 + k][0]), int(got[100 + k][1])) for k in range(len(ratio))] == list(ratio.values())
    for e in ("(sqrt (bigrat (bigint 2) (bigint 1)))", "(log (bigrat (bigint 2) (bigint 1)))", "(pow (bigrat (bigint 0) (bigint 1)) (bigrat (bigint -1) (bigint 1)))"):
        with pytest.raises(Exception, match="no result"):
            ok(spark, f"(relation q (BigRat)) (q {e})")
    ok(spark, "(relation q (i64 i64)) (q (ordering-min 4 9) (ordering-max 4 9)) (check (q 4 9))")


def test_ratios_are_reduced_once_and_beyond_64_bits(spark, data):
    """Of every length up to 34 digits, beyond which Spark's decimals aren't exact; Fibonacci numbers take the most steps."""
    from rulespan.functions import scalar
    from rulespan.plans.queries import QUERIES

    plan = QUERIES["bigrat_ops"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    # Three ratios, each by 64 bits or by decimals.
    assert 0 < plan.count("aggregate(") <= 6
    fib = [1, 1]
    while fib[-1] < 10**33:
        fib.append(fib[-1] + fib[-2])
    tops = [0, 1, 2, 6, 10**18 - 1, 10**18, 10**18 + 1, 2**63 - 1, 2**63, 10**33 + 7, 10**34 - 1]
    cases = [(sign * n, d) for n in tops for d in (1, -2, 6, 7 * 10**17, 10**18, -(2**63), 10**34 - 1) for sign in (1, -1)]
    cases += [*zip(fib, fib[1:]), *zip(fib[1:], fib), *((6 * n, 6 * (n + 1)) for n in fib), (5, 0), (0, 0)]
    frame = spark.createDataFrame([(k, str(n), str(d)) for k, (n, d) in enumerate(cases)], "k long, n string, d string")
    got = dict(frame.select("k", scalar.find("bigrat", ["BigInt", "BigInt"])[0](F.col("n").cast("decimal(38,0)"), F.col("d").cast("decimal(38,0)"))).collect())
    assert [got[k] and (int(got[k].num), int(got[k].den)) for k in range(len(cases))] == [Fraction(n, d).as_integer_ratio() if d else None for n, d in cases]
