"""Programs from outside: lookups, printing, schedulers, limits, saving, traces, proofs, macros, host functions."""

import io

import pytest
from pyspark.sql import functions as F

from rulespan.operators.extraction import CostModel
from rulespan.operators.program import Program
from rulespan.operators.schedulers import BackOff, FirstN, LimitReached
from rulespan.plans.parser import Lit, ProgramError, Sym, read


def ok(spark, text, **options):
    p = Program(spark, **options)
    return p, p.run(text)


CHAIN = "(relation road (i64 i64)) (relation reach (i64 i64)) (road 10 20) (road 20 30) (road 30 40) (rule ((road a b)) ((reach a b)) :name \"base\") (rule ((reach a b) (road b c)) ((reach a c)) :name \"more\")"


def test_lookup_rows_and_statistics(spark):
    p, _ = ok(spark, "(function price (String i64) f64 :merge new) (relation seen (i64)) (set (price \"a\" 1) 2.5) (set (price \"b\" 1) 0.5) (seen 4)")
    assert p.lookup("price", "a", 1) == 2.5 and p.lookup("price", "a", 2) is None and p.lookup("seen", 4) is True and p.lookup("seen", 5) is False
    with pytest.raises(ProgramError):
        p.lookup("price", "a")
    rows = []
    assert p.for_each("price", rows.append) == 2 and sorted(rows) == [("a", 1, 2.5), ("b", 1, 0.5)]
    assert p.for_each("price", lambda row: False) == 1
    s = p.statistics("price")
    assert s["rows"] == 2 and s["distinct"] == {"k0": 2, "k1": 1, "ret": 2}
    step = p.step
    p.run("(seen 5)")
    assert [r[0] for r in p.changed_since("seen", step).collect()] == [5]
    drained = p.drain("seen")
    assert p.size("seen") == 0 and sorted(r[0] for r in drained.collect()) == [4, 5] and p.drain("seen").count() == 0
    other, _ = ok(spark, "(function price (String i64) f64 :merge new) (set (price \"a\" 1) 2.5)")
    mine, theirs = p.difference_to(other)["price"]
    assert [tuple(r) for r in mine.collect()] == [("b", 1, 0.5)] and theirs.count() == 0


def test_print_function_as_terms(spark, tmp_path):
    text = """(datatype Shape (Dot i64) (Group Shapes) (Named String)) (sort Shapes (Vec Shape)) (function size (Shape) i64 :merge new) (relation odd (f64 bool))
        (let g (Group (vec-of (Dot 1) (Named "x\\"y")))) (set (size g) 7) (odd 1234567890.5 true) (odd 2.0 false)"""
    text = text.replace("(datatype Shape (Dot i64) (Group Shapes) (Named String)) (sort Shapes (Vec Shape))", "(datatype* (Shape (Dot i64) (Group Shapes) (Named String)) (sort Shapes (Vec Shape)))")
    p, out = ok(spark, text + "(print-function size) (print-function odd 1) (print-function odd)")
    assert out == ['(size (Group (vec-of (Dot 1) (Named "x\\"y")))) -> 7', "(odd 1234567890.5 true)", "(odd 1234567890.5 true)", "(odd 2.0 false)"]
    p.run(f'(print-function odd 10 :file "{tmp_path}/odd" :mode csv)')
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/odd").collect()) == ["odd,1234567890.5,true", "odd,2.0,false"]
    p, out = ok(spark, '(sort S) (constructor A () S :unextractable) (constructor B (S) S) (relation r (S)) (r (A)) (print-function r)')
    assert out == ["(r Unextractable)"]
    p, out = ok(spark, "(sort M (Map i64 String)) (sort P (Pair i64 f64)) (sort B (MultiSet i64)) (relation m (M P B)) (m (map-insert (map-empty) 1 \"a\") (pair 1 0.5) (multiset-of 2 2)) (print-function m)")
    assert out == ['(m (map-insert (map-empty) 1 "a") (pair 1 0.5) (multiset-of 2 2))']


def test_extraction_of_containers_and_costs(spark):
    text = """(datatype* (Part (Sum i64 i64) (Big :cost 50) (Hold Parts)) (sort Parts (Vec Part)))
        (let costly (vec-of (Big))) (let cheap (vec-of (Sum 1 2))) (let h (Hold cheap)) (union h (Big))"""
    p, _ = ok(spark, text)
    assert p.extract("costly") == [(4, "(vec-of (Hold (vec-of (Sum 1 2))))")]
    assert p.extract("h") == [(4, "(Hold (vec-of (Sum 1 2)))")]
    assert [c for c, _ in p.extract("h", 5)] == [4, 50]

    class Deep(CostModel):
        """What counts is the depth."""

        def row(self, table, children):
            return F.lit(1).cast("long") + (F.greatest(*children, F.lit(0).cast("long")) if children else F.lit(0).cast("long"))

    assert p.extract("h", model=Deep())[0][0] == 1
    assert p.reachable("Part") == {"Sum", "Big", "Hold"}
    p, _ = ok(spark, "(datatype A (X i64)) (datatype B (Y A) (Z)) (sort C) (constructor W (B) C) (let c (W (Y (X 3))))")
    assert p.reachable("B") == {"X", "Y", "Z"} and p.extract("c") == [(4, "(W (Y (X 3)))")]
    with pytest.raises(ProgramError, match="nothing to extract"):
        ok(spark, "(sort S) (constructor A () S :unextractable) (extract (A))")


def test_stats_and_naive(spark):
    p, out = ok(spark, CHAIN + "(run 5) (print-stats)", stats=True)
    assert [line.split(",")[:1] + line.split(",")[1:2] for line in out] == [["base: 4 runs", " 3 matches"], ["more: 4 runs", " 3 matches"]]
    q, out = ok(spark, CHAIN + "(run 5) (print-stats)")
    assert "matches" not in out[0] and sorted(map(tuple, q.rows("reach").collect())) == sorted(map(tuple, p.rows("reach").collect()))


def test_schedulers_fire_all_in_the_end(spark):
    want = sorted(map(tuple, ok(spark, CHAIN + "(run 9)")[0].rows("reach").collect()))
    for scheduler in (FirstN(1), BackOff(1, 2)):
        p, _ = ok(spark, CHAIN)
        steps = p.saturate_with(scheduler)
        assert sorted(map(tuple, p.rows("reach").collect())) == want and steps > 4, scheduler


def test_limits_undo_the_step(spark):
    p, _ = ok(spark, "(relation n (i64)) (n 0) (rule ((n x)) ((n (+ x 1))))", most_steps=3)
    with pytest.raises(LimitReached):
        p.saturate()
    assert p.size("n") == 4
    p, _ = ok(spark, "(relation n (i64)) (n 0) (rule ((n x)) ((n (+ x 1)) (n (+ x 100))))", most_rows=10)
    with pytest.raises(LimitReached):
        p.saturate()
    assert p.size("n") <= 10


def test_saving_and_resuming(spark, tmp_path):
    text = """(datatype Item (I i64)) (sort Items (Vec Item)) (function best (Item) i64 :merge (max old new)) (relation edge (i64 i64)) (relation has (Items)) (ruleset r)
        (rule ((edge a b)) ((union (I a) (I b))) :ruleset r) (let $x (I 1)) (has (vec-of (I 1) (I 2))) (set (best (I 2)) 5) (edge 1 2)"""
    p, _ = ok(spark, text + "(run r 3)")
    p.save(str(tmp_path / "s"), note="here")
    q = Program.resume(spark, str(tmp_path / "s"))
    assert q.resumed == {"note": "here"} and q.step == p.step and [q.size(n) for n in ("I", "best", "edge", "has")] == [p.size(n) for n in ("I", "best", "edge", "has")]
    q.run("(check (= $x (I 2))) (check (has (vec-of $x $x))) (edge 2 3) (run r 2) (check (= (I 1) (I 3))) (check (= (best (I 3)) 5))")
    # Rules go on with what is new only.
    p, _ = ok(spark, CHAIN + "(run 9)", stats=True)
    p.save(str(tmp_path / "c"))
    q = Program.resume(spark, str(tmp_path / "c"), stats=True)
    before = [r.matches for r in q.rulesets[""]]
    q.run("(run 1)")
    assert [r.matches for r in q.rulesets[""]] == before and q.size("reach") == 6


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from rulespan.streaming.incremental import start_saved

    make = lambda: ok(spark, "(relation e (i64 i64)) (relation p (i64 i64)) (function n (i64) i64 :merge (+ old new)) (rule ((e x y)) ((p x y) (set (n 0) 1))) (rule ((p x y) (p y z)) ((p x z)))")[0]
    for k in range(2):
        spark.createDataFrame([(k, k + 1)], "a long, b long").write.parquet(str(tmp_path / f"in/b{k}"))
        stream = spark.readStream.schema("a long, b long").parquet(str(tmp_path / "in/*"))
        program, query = start_saved(make, "e", stream, str(tmp_path / "ckpt"))
        query.awaitTermination(120)
    assert sorted(map(tuple, program.rows("p").collect())) == [(0, 1), (0, 2), (1, 2)]
    assert program.lookup("n", 0) == 2 and program.resumed["batch"] == 0


def test_trace_and_proofs(spark):
    p, out = ok(spark, CHAIN + "(run 5) (prove (reach 10 40))", trace=True)
    assert out[0].startswith("(reach 10 40) by more") and out[-1].strip().startswith("(road 30 40) by given") or "given" in out[-1]
    proof = p.prove("(reach 10 40)")
    assert p.check_proof(proof) and proof.bindings == {"a": 10, "b": 30, "c": 40} and [x.table for x in proof.premises] == ["reach", "road"]
    proof.premises[0].row = (10, 20)
    assert not p.check_proof(proof)
    assert p.traced_matches().count() == 6 and p.traced_writes("reach").count() == 6
    with pytest.raises(ProgramError):
        p.prove("(reach 40 10)")
    with pytest.raises(ProgramError, match="trace"):
        ok(spark, CHAIN + "(run 5)")[0].prove("(reach 10 20)")


def test_equality_paths(spark):
    p, _ = ok(spark, "(sort N) (constructor V (i64) N) (relation same (i64 i64)) (relation id (i64 N)) (rule ((same a b)) ((union (V a) (V b))) :name \"join\") (id 1 (V 1)) (id 2 (V 2)) (id 3 (V 3)) (id 9 (V 9))", trace=True)
    ids = {r[0]: r[1] for r in p.rows("id").collect()}
    p.run("(same 1 2) (run 1) (same 2 3) (run 1)")
    path = p.equality_path(ids[1], ids[3])
    assert path and path[0][0] == ids[1] and path[-1][1] == ids[3] and {r for _, _, r, _ in path} == {"join"}
    assert p.equality_path(ids[1], ids[9]) is None and p.equality_path(ids[1], ids[1]) == []
    assert p.traced_unions().count() == 2


def test_macros_and_commands(spark):
    p = Program(spark)
    p.macros["swap"] = lambda x: [x[1], x[3], x[2]]
    p.command_macros.append(lambda c: [c, [Sym("logged"), Lit(1)]] if c[0].name == "noted" else [c])
    p.commands["twice"] = lambda program, args: [program.command(args[0]) for _ in range(2)]
    p.run("(relation r (i64 i64)) (relation noted (i64)) (relation logged (i64)) (swap r 1 2) (noted 7) (twice (r 5 6)) (check (r 2 1)) (check (logged 1)) (check (r 5 6))")
    p.run("(relation q (i64 i64)) (rule ((swap r a b)) ((swap q a b))) (run 1) (check (q 2 1))")


def test_host_rules_and_primitives(spark):
    p, _ = ok(spark, "(relation word (String)) (relation part (String String)) (sort S) (constructor W (String) S) (relation seen (S)) (word \"a-b\") (word \"c\")")
    p.host_rule("(word w)", lambda m: {"part": m.select("w", F.explode(F.split("w", "-"))), "W": m.select("w")})
    p.run('(run 2) (check (part "a-b" "a")) (check (part "a-b" "b")) (check (= x (W "c")))')
    assert p.size("part") == 3 and p.size("W") == 2
    p.primitive("shout", ["String"], "String", F.upper)
    p.primitive("shout", ["i64"], "String", lambda x: F.concat(x.cast("string"), F.lit("!")))
    p.run('(relation loud (String)) (rule ((word w)) ((loud (shout w)))) (run 1) (check (loud "A-B")) (loud (shout 3)) (check (loud "3!"))')

    def count(program, df, cols, effects):
        return df, F.lit(program.size("word")).cast("long")

    p.primitive("words", [], "i64", count, "read")
    p.run("(relation n (i64)) (n (words)) (check (n 2))")
    with pytest.raises(ProgramError, match="naive"):
        p.run("(rule ((word w)) ((n (words))))")
    p.run("(rule ((word w)) ((n (words))) :naive) (run 1)")

    def join_all(program, df, cols, effects):
        effects.edges.append(df.select(cols[0].alias("a"), cols[1].alias("b")))
        return df, cols[0]

    p.primitive("glue", ["S", "S"], "S", join_all, "write")
    p.run('(seen (glue (W "a-b") (W "c"))) (check (= (W "a-b") (W "c")))')


def test_builders_scopes_and_failing_commands(spark, tmp_path):
    p = Program(spark)
    p.add_sort("T")
    p.add_sort("Ts", "(Vec T)")
    p.add_ruleset("one")
    p.relation("a", ["i64"])
    p.function("f", ["i64"], "i64", "(min old new)")
    p.constructor("K", ["i64"], "T", 3)
    p.add_rule("(a x)", "(set (f x) (* x 2)) (K x)", "one", "double")
    p.run("(a 4) (ruleset two) (unstable-combined-ruleset both one two) (rule ((K n)) ((a n)) :ruleset two) (run both 2) (check (= (f 4) 8)) (extract (K 4))")
    assert p.outputs[-1] == "(K 4)" and p.extract("(K 4)")[0][0] == 4
    # What a failing command has done is undone, and other failures aren't taken for it.
    p.run('(fail (panic "no")) (fail (a 1 2)) (fail (a (/ 1 0)))')
    assert p.size("a") == 1
    with pytest.raises(ProgramError, match="was to fail"):
        p.run("(fail (a 9))")
    p.run("(birewrite (K 1) (K 2) :name \"both\")")
    assert [r.name for r in p.rulesets[""]] == ["both=>", "both<="]
    (tmp_path / "inc.txt").write_text("(a 77)")
    p.run(f'(include "{tmp_path}/inc.txt") (check (a 77)) (push) (a 78) (pop) (fail (check (a 78)))')
    with pytest.raises(ProgramError, match="null"):
        p.load("a", spark.createDataFrame([(1,), (None,)], "x long"), nulls="error")
    assert p.load("a", spark.createDataFrame([(501,), (None,), (4,)], "x long")) == 1


def test_terminal_loop(spark):
    from rulespan.__main__ import balanced, loop

    assert balanced('(a "(" ; )\n)') and not balanced("(a (b)")
    out = io.StringIO()
    loop(Program(spark), ["(relation r (i64))\n", "(r\n", "1)\n", "(check (r 2))\n", "(print-size r)\n"], out)
    assert out.getvalue().splitlines()[-1] == "1" and out.getvalue().startswith("error: ")


def test_text_reads_back():
    from rulespan.operators.persistence import unread

    text = '(rule ((= x "a\\n\\"b") (f 1 -2.5 true)) ((g x)) :name "n")'
    assert unread(read(text)[0]) == text


def test_ways_to_join_agree(spark):
    """Cyclic, acyclic, falling apart, with repeated variables, literals and primitives, and with no rows."""
    facts = " ".join(f"(e {a} {b})" for a, b in [(1, 2), (2, 3), (3, 1), (3, 4), (4, 1), (2, 4), (5, 5), (4, 2), (1, 3)]) + " (l 1 7) (l 3 8) (l 5 9) (flag 1)"
    bodies = [
        (["a", "b", "c"], "(e a b) (e b c) (e c a)"), (["a", "d"], "(e a b) (e b c) (e c d) (l d x)"), (["a"], "(e a a)"), (["a", "x"], "(e a b) (l x y) (flag z)"), (["b"], "(e 3 b) (> b 1)"),
        (["a", "b", "c", "d"], "(e a b) (e b c) (e c d) (e d a) (!= a c)"), (["a", "s"], "(e a b) (l b y) (= s (+ a y))"), (["a"], "(e a b) (none b)"), (["a"], "(e a b) (flag 2)"),
    ]
    found = []
    for strategy in ("binary", "generic", "reduced"):
        p, _ = ok(spark, f"(relation e (i64 i64)) (relation l (i64 i64)) (relation flag (i64)) (relation none (i64)) {facts}", strategy=strategy)
        found.append([sorted(map(tuple, p.query(v, b).collect())) for v, b in bodies])
    assert found[0] == found[1] == found[2] and [len(r) > 0 for r in found[0]] == [True] * 7 + [False] * 2


def test_products_are_bounded(spark, monkeypatch):
    from rulespan.plans import rules

    monkeypatch.setattr(rules, "MOST_PRODUCT", 5)
    p, _ = ok(spark, "(relation a (i64)) (relation b (i64)) (a 1) (a 2) (a 3) (b 1) (b 2)")
    assert p.query(["x"], "(a x) (b y)").count() == 3
    with pytest.raises(ProgramError, match="product"):
        p.query(["x", "y"], "(a x) (b y)")


def test_dot_export(spark, tmp_path):
    from rulespan.sources.files import export_dot

    p, _ = ok(spark, '(datatype T (Leaf String) (Node T T)) (Node (Leaf "a") (Leaf "b"))')
    export_dot(p, str(tmp_path / "dot"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "dot")).collect()]
    assert lines[0].startswith("digraph") and lines[-1] == "}" and sum("->" in x for x in lines) == 2 and sum("subgraph" in x for x in lines) == 3


def test_restricted_steps(spark):
    p, _ = ok(spark, CHAIN)
    p.run_step()
    known = spark.createDataFrame([(10,)], "a long")
    p.run_step(without={"more": known})
    assert sorted(map(tuple, p.rows("reach").collect())) == [(10, 20), (20, 30), (20, 40), (30, 40)]
    with pytest.raises(ProgramError, match="no use"):
        p.run_step(without={"more": known.withColumnRenamed("a", "zz")})


def test_occurrences_and_colours(spark):
    from rulespan.operators.extraction import UnitCosts

    tree = "(sort T) (constructor L (i64) T) (constructor N (T T) T) (sort Ts (Vec T)) (relation has (Ts)) "
    p, _ = ok(spark, tree + "(N (L 1) (N (L 2) (L 1))) (has (vec-of (L 1) (L 2)))")
    one = p.lookup("L", 1)
    assert {n: df.count() for n, df in p.occurrences(one).items()} == {"L": 1, "N": 2, "has": 1}
    assert p.extract("(N (L 1) (N (L 2) (L 1)))", model=UnitCosts())[0][0] == 5
    plain = "(sort T) (constructor L (i64) T) (constructor N (T T) T) (relation r (i64)) "
    a, _ = ok(spark, plain + "(r 1) (N (L 1) (N (L 2) (L 1)))")
    b, _ = ok(spark, plain + "(L 2) (r 1) (N (L 1) (N (L 2) (L 1)))")  # other names of ids
    c, _ = ok(spark, plain + "(r 1) (N (L 2) (N (L 2) (L 1)))")
    d, _ = ok(spark, plain + "(r 2) (N (L 1) (N (L 2) (L 1)))")
    assert a.lookup("L", 2) != b.lookup("L", 2) and not a.told_apart(b)
    assert a.told_apart(c) and a.told_apart(d) and a.colours().select("colour").distinct().count() == 4
