"""Queries of the rule engine over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.program import Program
from ..operators.schedulers import BackOff
from ..streaming.incremental import load_and_saturate
from .parser import ProgramError

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def program(spark: SparkSession, text: str, **facts: DataFrame) -> Program:
    """Declarations first, then facts; rules and commands come later."""
    p = Program(spark)
    p.run(text)
    for name, df in facts.items():
        p.load(name, df)
    return p


def next_orders(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its customer's next one."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", after.alias("after")).where("after is not null")


NEXT = "nexts AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders), edges AS (SELECT * FROM nexts WHERE b IS NOT NULL)"


@query("SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus = 'F'")
def scan_filter_project(spark, d):
    p = program(spark, "(relation placed (i64 i64 String))", placed=table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return p.query(["c"], '(placed o c "F")')


@query("SELECT DISTINCT c_nationkey::BIGINT AS n, l_partkey AS part FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def conj_join_3(spark, d):
    p = program(
        spark,
        "(relation lives (i64 i64)) (relation placed (i64 i64 String)) (relation item (i64 i64))",
        lives=table(spark, d, "customer").select("c_custkey", "c_nationkey"),
        placed=table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"),
        item=table(spark, d, "lineitem").select("l_orderkey", "l_partkey"),
    )
    return p.query(["n", "part"], '(lives c n) (placed o c "F") (item o part)')


TRADE = "trade AS (SELECT DISTINCT c_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


def trade(spark, d, *more: str):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.select("c_nationkey", "s_nationkey", *more)


@query(f"WITH {TRADE} SELECT x.a AS a, y.a AS b, z.a AS c FROM trade x JOIN trade y ON x.b = y.a JOIN trade z ON y.b = z.a AND z.b = x.a WHERE x.a < y.a AND y.a < z.a")
def self_join_triangle(spark, d):
    p = program(spark, "(relation trade (i64 i64))", trade=trade(spark, d))
    return p.query(["a", "b", "c"], "(trade a b) (trade b c) (trade c a) (< a b) (< b c)")


@query("SELECT x.n_nationkey::BIGINT AS a, y.n_nationkey::BIGINT AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey")
def cross_theta(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    return program(spark, "(relation left (i64)) (relation right (i64))", left=n, right=n).query(["a", "b"], "(left a) (right b) (< a b)")


@query("SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def exists_check(spark, d):
    p = program(spark, "(relation customer (i64)) (relation placed (i64 i64))", customer=table(spark, d, "customer").select("c_custkey"), placed=table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    p.run("(check (customer c) (placed o c))")
    return p.query(["c"], "(customer c) (placed o c)")


@query("SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def fact_difference(spark, d):
    p = program(spark, "(relation customer (i64)) (relation placed (i64 i64 String))", customer=table(spark, d, "customer").select("c_custkey"), placed=table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    return p.difference("(customer c)", '(placed o c "1-URGENT")', ["c"])


@query(f"WITH RECURSIVE {NEXT}, path AS (SELECT a, b FROM edges UNION SELECT p.a, e.b FROM path p JOIN edges e ON p.b = e.a) SELECT a, b FROM path")
def tc_closure(spark, d):
    p = program(spark, "(relation edge (i64 i64)) (relation path (i64 i64)) (rule ((edge a b)) ((path a b))) (rule ((path a b) (path b c)) ((path a c)))", edge=next_orders(spark, d))
    p.saturate()
    return p.query(["a", "b"], "(path a b)")


@query(f"WITH RECURSIVE {NEXT}, path AS (SELECT a, b, 1 AS n FROM edges UNION SELECT p.a, e.b, n + 1 FROM path p JOIN edges e ON p.b = e.a WHERE n < 3) SELECT DISTINCT a, b FROM path")
def tc_bounded(spark, d):
    p = program(spark, "(relation edge (i64 i64)) (relation path (i64 i64)) (rule ((edge a b)) ((path a b))) (rule ((path a b) (edge b c)) ((path a c)))", edge=next_orders(spark, d))
    p.run("(run 3)")
    return p.query(["a", "b"], "(path a b)")


def merged(spark, d, kind: str, merge: str, column) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", column.alias("v"))
    p = program(spark, f"(function f (i64) {kind} {merge})", f=rows)
    return p.query(["k", "v"], "(= v (f k))")


@query("SELECT l_partkey AS k, min(l_extendedprice) AS v FROM lineitem GROUP BY 1")
def merge_min(spark, d):
    return merged(spark, d, "f64", ":merge (min old new)", F.col("l_extendedprice"))


@query("SELECT l_partkey AS k, max(l_suppkey) AS v FROM lineitem GROUP BY 1")
def merge_max(spark, d):
    return merged(spark, d, "i64", ":merge (max old new)", F.col("l_suppkey"))


@query("SELECT l_partkey AS k, bool_or(l_returnflag = 'R') AS v FROM lineitem GROUP BY 1")
def merge_or(spark, d):
    return merged(spark, d, "bool", ":merge (or old new)", F.col("l_returnflag") == "R")


@query("SELECT l_partkey AS k, bool_and(l_linestatus = 'O') AS v FROM lineitem GROUP BY 1")
def merge_and(spark, d):
    return merged(spark, d, "bool", ":merge (and old new)", F.col("l_linestatus") == "O")


@query("SELECT l_partkey AS k, sum(l_suppkey)::BIGINT AS v FROM lineitem GROUP BY 1")
def merge_fold(spark, d):
    return merged(spark, d, "i64", ":merge (+ old new)", F.col("l_suppkey"))


@query("SELECT l_partkey AS k, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS v FROM lineitem GROUP BY 1")
def merge_set_union(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.array("l_suppkey"))
    p = program(spark, "(sort Ids (Set i64)) (function f (i64) Ids :merge (set-union old new))", f=rows)
    return p.query(["k", "v"], "(= v (f k))").select("k", F.array_join(F.col("v").cast("array<string>"), ",").alias("v"))


@query("SELECT user_id AS u, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def merge_old_new(spark, d):
    """One batch for the first event of each user, one for the rest."""
    rows = table(spark, d, "events").select("user_id", "event_id")
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1
    rows = rows.withColumn("early", first)
    p = program(spark, "(function first (i64) i64 :merge old) (function last (i64) i64 :merge new)")
    for early in (True, False):
        for name in ("first", "last"):
            p.load(name, rows.where(F.col("early") == early).drop("early"))
    return p.query(["u", "first", "last"], "(= first (first u)) (= last (last u))")


@query("SELECT o_orderkey AS o, o_orderpriority AS prio, true AS refused FROM orders")
def nomerge_conflict(spark, d):
    """The same value twice is no conflict; another value for a key is refused, and nothing of that load stays."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    p = program(spark, "(function prio (i64) String :no-merge)", prio=rows.union(rows))
    try:
        p.load("prio", rows.select("o_orderkey", F.concat("o_orderpriority", F.lit("?"))))
        refused = False
    except ProgramError:
        refused = True
    return p.query(["o", "prio"], "(= prio (prio o))").withColumn("refused", F.lit(refused))


TRADED = "e AS (SELECT c_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b, min(l_partkey) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


@query(f"WITH {TRADED}, p AS (SELECT * FROM e UNION ALL SELECT x.a, y.b, x.w + y.w FROM e x JOIN e y ON x.b = y.a UNION ALL SELECT x.a, z.b, x.w + y.w + z.w FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a) SELECT a, b, min(w)::BIGINT AS d FROM p GROUP BY 1, 2")
def shortest_path(spark, d):
    """Over up to three edges; nearly every pair has many paths, and shorter ones are found after longer ones."""
    edges = trade(spark, d, "l_partkey").groupBy("c_nationkey", "s_nationkey").agg(F.min("l_partkey"))
    p = program(
        spark,
        """(relation step (i64 i64 i64)) (function dist (i64 i64) i64 :merge (min old new))
        (rule ((step a b w)) ((set (dist a b) w))) (rule ((= d (dist a b)) (step b e w)) ((set (dist a e) (+ d w))))""",
        step=edges,
    )
    p.run("(run 3)")
    return p.query(["a", "b", "d"], "(= d (dist a b))")


@query("SELECT o_orderkey AS x, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM orders")
def components(spark, d):
    p = program(
        spark,
        """(sort Vertex) (constructor Node (i64) Vertex) (relation edge (i64 i64)) (relation known (i64)) (function least (Vertex) i64 :merge (min old new))
        (rule ((known x)) ((set (least (Node x)) x))) (rule ((edge x y)) ((union (Node x) (Node y))))""",
        edge=next_orders(spark, d),
        known=table(spark, d, "orders").select("o_orderkey"),
    )
    p.saturate()
    return p.query(["x", "root"], "(= n (Node x)) (= root (least n))")


@query("SELECT o_orderkey AS x, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def congruence_merge(spark, d):
    """Rows over ids that become equal collide and merge, one level up too."""
    p = program(
        spark,
        """(sort Vertex) (constructor Node (i64) Vertex) (sort Boxed) (constructor Box (Vertex) Boxed) (relation edge (i64 i64)) (relation price (i64 f64)) (function top (Boxed) f64 :merge (max old new))
        (rule ((price x v)) ((set (top (Box (Node x))) v))) (rule ((edge x y)) ((union (Node x) (Node y))))""",
        edge=next_orders(spark, d),
        price=table(spark, d, "orders").select("o_orderkey", "o_totalprice"),
    )
    p.saturate()
    return p.query(["x", "top"], "(= top (top (Box (Node x))))")


@query("SELECT 'sent' AS t, r_regionkey::BIGINT AS n FROM region UNION ALL SELECT 'answered', r_regionkey::BIGINT FROM region WHERE r_regionkey < 4")
def rules_schedule(spark, d):
    """Two rulesets in turn, each to its fixpoint: every answer lets one more be sent."""
    p = program(
        spark,
        """(relation region (i64)) (relation sent (i64)) (relation answered (i64)) (ruleset answer) (ruleset send) (sent 0)
        (rule ((sent x) (= y (+ x 1)) (region y)) ((answered x)) :ruleset answer) (rule ((answered x)) ((sent (+ x 1))) :ruleset send)""",
        region=table(spark, d, "region").select("r_regionkey"),
    )
    p.run("(run-schedule (repeat 100 (saturate answer) (saturate send)))")
    name = lambda n: p.rows(n).select(F.lit(n).alias("t"), F.col("k0").alias("n"))
    return name("sent").unionByName(name("answered"))


@query("SELECT range AS n FROM range(0, 7)")
def until_stop(spark, d):
    p = program(spark, "(relation n (i64)) (n 0) (rule ((n x)) ((n (+ x 1)))) (run 1000 :until (n 6))")
    return p.query(["n"], "(n n)")


@query("SELECT o_orderkey AS o FROM orders WHERE o_orderstatus <> 'F'")
def delete_rows(spark, d):
    p = program(spark, '(relation placed (i64 String)) (rule ((placed o "F")) ((delete (placed o "F"))))', placed=table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))
    p.saturate()
    return p.query(["o"], "(placed o s)")


@query("SELECT o_orderkey AS o, o_orderstatus = 'F' AS hidden FROM orders")
def subsume_rows(spark, d):
    p = program(spark, '(relation placed (i64 String)) (rule ((placed o "F")) ((subsume (placed o "F"))))', placed=table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))
    p.saturate()
    p.run('(check (placed o "F"))')
    seen = p.query(["o"], "(placed o s)").withColumn("seen", F.lit(True))
    return p.rows("placed").select(F.col("k0").alias("o")).join(seen, "o", "left").select("o", F.col("seen").isNull().alias("hidden"))


@query("SELECT n_nationkey::BIGINT AS n, CASE WHEN n_regionkey = 0 THEN 2 ELSE 7 END::BIGINT AS cost FROM nation")
def extract_cost(spark, d):
    """The cheapest term of each nation: a short name exists for one region's."""
    p = program(
        spark,
        """(datatype Place (Region i64 :cost 2) (Nation Place i64 :cost 3) (Short i64)) (relation located (i64 i64))
        (rule ((located n r)) ((Nation (Region r) n))) (rule ((located n 0)) ((union (Nation (Region 0) n) (Short n))))""",
        located=table(spark, d, "nation").select("n_nationkey", "n_regionkey"),
    )
    p.saturate()
    return p.query(["n", "id"], "(located n r) (= id (Nation (Region r) n))").join(p.term_costs(), "id").select("n", "cost")


@query(
    "SELECT o_orderkey AS o, (o_orderkey + o_custkey) AS plus, (o_orderkey * o_custkey) AS times, (o_orderkey // o_custkey) AS quotient, (o_orderkey % o_custkey) AS rest, (o_orderkey & o_custkey) AS both, xor(o_orderkey, o_custkey) AS either, least(o_orderkey, o_custkey) AS low, floor(log2(o_orderkey + 0.5))::BIGINT AS bits, CAST(o_orderkey AS VARCHAR) AS text FROM orders WHERE o_custkey > 0 AND o_orderkey > 0"
)
def prim_i64(spark, d):
    p = program(spark, "(relation placed (i64 i64))", placed=table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    names = ["o", "plus", "times", "quotient", "rest", "both", "either", "low", "bits", "text"]
    return p.query(names, "(placed o c) (> c 0) (> o 0) (= plus (+ o c)) (= times (* o c)) (= quotient (/ o c)) (= rest (% o c)) (= both (& o c)) (= either (^ o c)) (= low (min o c)) (= bits (log2 o)) (= text (to-string o))")


@query("SELECT l_orderkey AS o, l_linenumber::BIGINT AS n, (l_extendedprice * (1.0::DOUBLE - l_discount)) AS net, (l_extendedprice / l_quantity) AS unit, greatest(l_discount, l_tax) AS top, trunc(l_extendedprice)::BIGINT AS whole FROM lineitem WHERE l_quantity <> 0")
def prim_f64(spark, d):
    p = program(spark, "(relation item (i64 i64 f64 f64 f64 f64))", item=table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"))
    return p.query(["o", "n", "net", "unit", "top", "whole"], "(item o n p q d t) (= net (* p (- 1.0 d))) (= unit (/ p q)) (= top (max d t)) (= whole (to-i64 p))")


@query("SELECT n_nationkey::BIGINT AS k, n_name || '/' || n_name AS twice, replace(n_name, 'A', 'o') AS other, (length(n_name) - length(replace(n_name, 'A', '')))::BIGINT AS n FROM nation")
def prim_string(spark, d):
    p = program(spark, "(relation nation (i64 String))", nation=table(spark, d, "nation").select("n_nationkey", "n_name"))
    return p.query(["k", "twice", "other", "n"], '(nation k s) (= twice (+ s "/" s)) (= other (replace s "A" "o")) (= n (count-matches s "A"))')


@query("SELECT o_orderkey AS o, (o_custkey > 500) AND NOT (o_orderkey < 900) AS x, (o_custkey > 500) <> (o_orderkey < 900) AS y, (NOT (o_custkey > 500)) OR (o_orderkey < 900) AS z FROM orders")
def prim_bool(spark, d):
    p = program(spark, "(relation placed (i64 i64))", placed=table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    return p.query(["o", "x", "y", "z"], "(placed o c) (= p (bool-> c 500)) (= q (bool-< o 900)) (= x (and p (not q))) (= y (xor p q)) (= z (=> p q))")


@query("SELECT c_custkey AS c, 3 + c_nationkey::BIGINT AS n, c_custkey + 1 AS second, CASE WHEN c_nationkey > 0 THEN c_nationkey - 1 ELSE c_nationkey END::BIGINT AS last, c_custkey * 2 AS changed FROM customer")
def vec_ops(spark, d):
    p = program(spark, "(relation lives (i64 i64))", lives=table(spark, d, "customer").select("c_custkey", "c_nationkey"))
    return p.query(
        ["c", "n", "second", "last", "changed"],
        """(lives c k) (= v (vec-append (vec-of c (+ c 1) k) (vec-range k))) (= n (vec-length v)) (= second (vec-get v 1)) (= last (vec-get v (- n 1)))
        (= changed (vec-get (vec-set (vec-remove v 1) 0 (* c 2)) 0)) (vec-contains (vec-push (vec-pop v) k) k) (vec-not-contains v -1)""",
    )


@query("SELECT c_custkey AS c, CASE WHEN c_custkey = c_nationkey THEN 2 ELSE 3 END::BIGINT AS n, least(c_custkey, c_nationkey) AS low FROM customer WHERE c_nationkey <> -1 AND c_custkey >= 0")
def set_ops(spark, d):
    p = program(spark, "(relation lives (i64 i64))", lives=table(spark, d, "customer").select("c_custkey", "c_nationkey"))
    return p.query(["c", "n", "low"], "(lives c k) (= s (set-union (set-of c k) (set-of -1 c))) (= n (set-length s)) (= low (set-get s 0)) (set-not-contains (set-remove s c) c)")


@query("SELECT c_custkey AS c, CASE WHEN c_custkey = c_nationkey THEN 1 ELSE 2 END::BIGINT AS n, CASE WHEN c_custkey = c_nationkey THEN 0 ELSE c_nationkey * 3 END::BIGINT AS v, CASE WHEN c_custkey = c_nationkey THEN 0 ELSE 1 END::BIGINT AS rest FROM customer")
def map_ops(spark, d):
    """A key set twice has the later value; where both keys are one, one is left."""
    p = program(spark, "(relation lives (i64 i64))", lives=table(spark, d, "customer").select("c_custkey", "c_nationkey"))
    return p.query(
        ["c", "n", "v", "rest"],
        "(lives c k) (= m (map-insert (map-insert (map-insert (map-empty) c 5) k (* k 3)) c 0)) (= n (map-length m)) (= v (map-get m k)) (= r (map-remove m c)) (= rest (map-length r)) (map-contains m c) (map-not-contains r c)",
    )


@query("SELECT c_custkey AS c, 5::BIGINT AS n, CASE WHEN c_custkey = c_nationkey THEN 5 ELSE 3 END::BIGINT AS k, CASE WHEN c_custkey = c_nationkey THEN 4 ELSE 2 END::BIGINT AS fewer, CASE WHEN c_custkey = c_nationkey THEN 1 ELSE 2 END::BIGINT AS kinds, c_custkey AS most FROM customer")
def multiset_ops(spark, d):
    p = program(spark, "(relation lives (i64 i64))", lives=table(spark, d, "customer").select("c_custkey", "c_nationkey"))
    return p.query(
        ["c", "n", "k", "fewer", "kinds", "most"],
        """(lives c h) (= m (multiset-sum (multiset-of c c h) (multiset-insert (multiset-of h) c))) (= n (multiset-length m)) (= k (multiset-count m c))
        (= fewer (multiset-count (multiset-subtract m (multiset-of c)) c)) (= kinds (multiset-length (multiset-reset-counts m))) (= most (multiset-pick-max m)) (multiset-contains (multiset-intersection m (multiset-of h)) h)""",
    )


@query("SELECT c_custkey AS c, c_name AS name FROM customer")
def pair_ops(spark, d):
    p = program(spark, "(relation customer (i64 String))", customer=table(spark, d, "customer").select("c_custkey", "c_name"))
    return p.query(["c", "name"], "(customer k s) (= q (pair k s)) (= c (pair-first q)) (= name (pair-second q))")


@query("SELECT o_orderkey AS o, CAST(o_orderkey::HUGEINT * 1000000000000000000 * o_custkey + 1 AS VARCHAR) AS big FROM orders")
def bigint_ops(spark, d):
    p = program(spark, "(relation placed (i64 i64))", placed=table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    return p.query(["o", "big"], "(placed o c) (= big (to-string (+ (* (* (bigint o) (bigint 1000000000000000000)) (bigint c)) (bigint 1))))")


@query("SELECT o_orderkey AS o, CAST((3 * o_orderkey + 2 * o_custkey) // gcd(3 * o_orderkey + 2 * o_custkey, 6) AS VARCHAR) || '/' || CAST(6 // gcd(3 * o_orderkey + 2 * o_custkey, 6) AS VARCHAR) AS sum FROM orders")
def bigrat_ops(spark, d):
    p = program(spark, "(relation placed (i64 i64))", placed=table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    text = '(= sum (+ (to-string (numer r)) "/" (to-string (denom r))))'
    return p.query(["o", "sum"], f"(placed o c) (= r (+ (bigrat (bigint o) (bigint 2)) (bigrat (bigint c) (bigint 3)))) {text}")


@query("SELECT user_id AS u, event_type AS a, other AS b FROM (SELECT DISTINCT x.user_id, x.event_type, y.event_type AS other FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_type < y.event_type)")
def events_incremental(spark, d):
    """Batch by batch, with only what is new joined each time."""
    p = program(spark, "(relation did (i64 String)) (relation both (i64 String String)) (rule ((did u a) (did u b) (!= a b)) ((both u a b)))")
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id")
    mark = F.ntile(3).over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = rows.withColumn("batch", mark)
    for k in (1, 2, 3):
        load_and_saturate(p, "did", rows.where(F.col("batch") == k).select("user_id", "event_type"))
    return p.query(["u", "a", "b"], "(both u a b)").where("a < b")


# -- containers, functions, merges and terms --------------------------------------------------

REGIONS = "t AS (SELECT DISTINCT c_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), r AS (SELECT t.*, x.n_regionkey AS ra, y.n_regionkey AS rb FROM t JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b)"


def united(spark, d, more: str) -> Program:
    """Nations as ids, those of one region made equal after ``more`` has made rows over them."""
    p = program(
        spark,
        f"""(sort Place) (constructor N (i64) Place) (relation trade (i64 i64)) (relation lies (i64 i64)) (ruleset make) (ruleset unite) {more}
        (rule ((lies a r) (lies b r)) ((union (N a) (N b))) :ruleset unite)""",
        trade=trade(spark, d),
        lies=table(spark, d, "nation").select("n_nationkey", "n_regionkey"),
    )
    p.run("(run make 1) (run unite 1)")
    return p


@query(f"WITH {REGIONS} SELECT a, b, min(a * 100 + b) OVER (PARTITION BY ra, rb) AS least FROM r")
def container_rebuild(spark, d):
    """Vectors of ids become equal as their elements do, and rows over them merge."""
    p = united(spark, d, "(sort Way (Vec Place)) (sort Boxed) (constructor Box (Way) Boxed) (function least (Boxed) i64 :merge (min old new)) (rule ((trade a b)) ((set (least (Box (vec-of (N a) (N b)))) (+ (* a 100) b))) :ruleset make)")
    return p.query(["a", "b", "least"], "(trade a b) (= x (N a)) (= y (N b)) (= least (least (Box (vec-of x y))))")


@query(f"WITH {REGIONS} SELECT ra::BIGINT AS region, count(DISTINCT rb) AS n FROM r GROUP BY 1")
def container_sets_shrink(spark, d):
    """Sets of ids lose elements that become equal to others."""
    p = united(spark, d, "(sort Places (Set Place)) (function to (Place) Places :merge (set-union old new)) (rule ((trade a b)) ((set (to (N a)) (set-of (N b)))) :ruleset make)")
    return p.query(["region", "n"], "(lies a region) (= n (set-length (to (N a))))")


@query("SELECT c_custkey AS c, c_nationkey::BIGINT AS k, 2 - (c_custkey = c_nationkey)::BIGINT AS n, 1::BIGINT + (c_nationkey > 3)::BIGINT AS marks FROM customer")
def empty_containers(spark, d):
    p = program(
        spark,
        """(sort Numbers (Vec i64)) (sort Marks (Set String)) (relation lives (i64 i64)) (function marks (i64) Marks :merge (set-union old new)) (relation bare (Numbers)) (bare (vec-empty))
        (rule ((lives c k)) ((set (marks c) (set-insert (set-empty) "any")))) (rule ((lives c k) (> k 3)) ((set (marks c) (set-insert (set-empty) "far"))))""",
        lives=table(spark, d, "customer").select("c_custkey", "c_nationkey"),
    )
    p.run("(run 1)")
    return p.query(["c", "k", "n", "marks"], "(lives c h) (bare v) (= k (vec-get (vec-push v h) 0)) (= n (map-length (map-insert (map-insert (map-empty) c 1) h 2))) (= marks (set-length (marks c))) (= v (vec-empty))")


@query("SELECT l_orderkey AS o, sum(s)::BIGINT AS total FROM (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem) GROUP BY 1")
def merge_table(spark, d):
    """Values merge into terms by a constructor, whatever their order; the terms are summed up by rules."""
    p = program(
        spark,
        """(datatype Bag (One i64) (Both Bag Bag)) (function bag (i64) Bag :merge (Both old new)) (function total (Bag) i64 :merge (max old new)) (relation item (i64 i64)) (ruleset gather) (ruleset sum)
        (rule ((item o s)) ((set (bag o) (One s))) :ruleset gather) (rule ((= b (One s))) ((set (total b) s)) :ruleset sum) (rule ((= b (Both x y)) (= m (total x)) (= n (total y))) ((set (total b) (+ m n))) :ruleset sum)""",
        item=table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"),
    )
    p.run("(run gather 1) (run-schedule (saturate sum))")
    return p.query(["o", "total"], "(= b (bag o)) (= total (total b))")


@query("SELECT o_orderkey AS o, CASE o_orderstatus WHEN 'F' THEN 3 * o_custkey WHEN 'O' THEN o_custkey + 100 ELSE least(o_custkey, 50) END::BIGINT AS v FROM orders")
def function_values(spark, d):
    """A function for each status, kept in a table and applied to each order's customer."""
    p = program(
        spark,
        """(sort OnNumber (UnstableFn (i64) i64)) (relation rate (String OnNumber)) (relation placed (i64 i64 String)) (relation rated (i64 i64))
        (rate "F" (unstable-fn "*" 3)) (rate "O" (unstable-fn "+" 100)) (rate "P" (unstable-fn "min" 50))
        (rule ((placed o c s) (rate s f)) ((rated o (unstable-app f c))))""",
        placed=table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"),
    )
    p.run("(run 1)")
    return p.query(["o", "v"], "(rated o v)")


@query("SELECT c_custkey AS c, c_custkey * 2 AS first, (c_custkey + c_nationkey * 2)::BIGINT AS total, (c_nationkey > 0)::BIGINT AS kept FROM customer")
def function_values_over_containers(spark, d):
    p = program(
        spark,
        """(sort Numbers (Vec i64)) (sort Bag (MultiSet i64)) (relation lives (i64 i64)) (function doubled (i64) Numbers :no-merge) (function sum (i64) i64 :no-merge) (function left (i64) Bag :no-merge)
        (rule ((lives c k)) ((set (doubled c) (unstable-vec-map (unstable-fn "*" 2) (vec-of c k))) (set (sum c) (unstable-multiset-reduce (unstable-fn "+") 0 (multiset-of c k k))) (set (left c) (unstable-multiset-filter (unstable-fn "log2") (multiset-of k)))))""",
        lives=table(spark, d, "customer").select("c_custkey", "c_nationkey"),
    )
    p.run("(run 1)")
    return p.query(["c", "first", "total", "kept"], "(= first (vec-get (doubled c) 0)) (= total (sum c)) (= kept (multiset-length (left c)))")


@query("SELECT '(Nation (Region ' || n_regionkey || ' \"' || r_name || '\") ' || n_nationkey || ')' AS term FROM nation JOIN region ON n_regionkey = r_regionkey")
def rows_to_terms(spark, d):
    p = program(
        spark,
        "(datatype Place (Region i64 String) (Nation Place i64)) (relation lies (i64 i64 String)) (rule ((lies n r s)) ((Nation (Region r s) n)))",
        lies=table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_regionkey", "r_name"),
    )
    p.run("(run 1)")
    return p.terms("Nation").select(F.concat(F.lit("(Nation "), "k0", F.lit(" "), "k1", F.lit(")")).alias("term"))


@query(f"WITH {REGIONS} SELECT DISTINCT least(a, b) AS low, greatest(a, b) AS high, (SELECT count(*) FROM t y WHERE (y.a, y.b) IN ((r.a, r.b), (r.b, r.a))) AS n FROM r")
def rewrites(spark, d):
    """Terms of two arguments are equal either way round; each class counts the facts it stands for."""
    p = program(
        spark,
        """(datatype Way (From i64 i64)) (relation trade (i64 i64)) (function low (Way) i64 :merge (min old new)) (function high (Way) i64 :merge (max old new)) (function n (Way) i64 :merge (+ old new)) (ruleset count)
        (rule ((trade a b)) ((From a b))) (rewrite (From a b) (From b a) :name "turn") (rule ((trade a b) (= w (From a b))) ((set (n w) 1) (set (low w) (min a b)) (set (high w) (max a b))) :ruleset count)""",
        trade=trade(spark, d),
    )
    p.run("(run 3) (run count 1)")
    return p.query(["low", "high", "n"], "(= n (n w)) (= low (low w)) (= high (high w))")


@query("SELECT l_orderkey AS o, l_linenumber::BIGINT AS n, CAST(l_extendedprice AS VARCHAR) AS price, CAST(l_discount AS VARCHAR) AS discount FROM lineitem")
def prim_f64_text(spark, d):
    p = program(spark, "(relation item (i64 i64 f64 f64))", item=table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"))
    return p.query(["o", "n", "price", "discount"], "(item o n p x) (= price (to-string p)) (= discount (to-string x))")


@query("SELECT o_orderkey AS o, CAST(big & 1023::HUGEINT AS VARCHAR) AS low, CAST(big | 1023::HUGEINT AS VARCHAR) AS high, CAST(xor(big, 1023::HUGEINT) AS VARCHAR) AS other, CAST(big << 5 AS VARCHAR) AS wide, CAST(big >> 3 AS VARCHAR) AS narrow, CAST(-big - 1 AS VARCHAR) AS flipped FROM (SELECT o_orderkey, o_orderkey::HUGEINT * 1000000000000 + o_custkey AS big FROM orders)")
def bigint_bits(spark, d):
    p = program(spark, "(relation placed (i64 i64))", placed=table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    return p.query(
        ["o", "low", "high", "other", "wide", "narrow", "flipped"],
        """(placed o c) (= b (+ (* (bigint o) (bigint 1000000000000)) (bigint c))) (= m (bigint 1023)) (= low (to-string (& b m))) (= high (to-string (| b m))) (= other (to-string (^ b m)))
        (= wide (to-string (<< b 5))) (= narrow (to-string (>> b 3))) (= flipped (to-string (not-Z b)))""",
    )


@query("SELECT o_orderkey AS o, CAST(o_orderkey // (c + 1) AS VARCHAR) AS down, CAST((o_orderkey + c) // (c + 1) AS VARCHAR) AS up, CAST((2 * o_orderkey + c + 1) // (2 * (c + 1)) AS VARCHAR) AS near, CAST((o_orderkey * o_orderkey) // gcd(o_orderkey * o_orderkey, (c + 1) * (c + 1)) AS VARCHAR) AS squared FROM (SELECT o_orderkey, o_custkey AS c FROM orders WHERE o_orderkey > 0)")
def bigrat_functions(spark, d):
    p = program(spark, "(relation placed (i64 i64))", placed=table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    number = lambda name, f: f"(= {name} (to-string (numer {f})))"
    return p.query(
        ["o", "down", "up", "near", "squared"],
        f"(placed o c) (> o 0) (= r (bigrat (bigint o) (bigint (+ c 1)))) (= two (bigrat (bigint 2) (bigint 1))) {number('down', '(floor r)')} {number('up', '(ceil r)')} {number('near', '(round r)')} (= s (pow r two)) {number('squared', 's')} (= r (sqrt s)) (= r (min r (max r r)))",
    )


# -- runs from outside ------------------------------------------------------------------------

TURNS = "(relation next (i64 i64 i64)) (relation after (i64 i64 i64)) (rule ((next c a b)) ((after c a b)) :name \"one\") (rule ((after c a b) (next c b e)) ((after c a e)) :name \"more\")"
AFTER = "SELECT DISTINCT x.conv_id AS c, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn"


def turns(spark, d) -> DataFrame:
    """Each turn of a conversation with the next one."""
    after = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn").distinct().select("conv_id", "turn", after.alias("after")).where("after is not null")


@query(AFTER)
def scheduled_closure(spark, d):
    """A rule with many matches is banned for some steps; nothing is lost by it."""
    p = program(spark, TURNS, next=turns(spark, d))
    p.saturate_with(BackOff(limit=100, ban=2))
    return p.query(["c", "a", "b"], "(after c a b)")


@query(AFTER)
def saved_and_resumed(spark, d):
    """Half of the facts, saved; then the rest, in a program made from what was saved."""
    rows = turns(spark, d)
    p = program(spark, TURNS, next=rows.where("conv_id % 2 = 0"))
    p.saturate()
    path = f"{p.store.scratch.path}/saved"
    p.save(path)
    q = Program.resume(spark, path)
    q.load("next", rows.where("conv_id % 2 <> 0"))
    q.saturate()
    return q.query(["c", "a", "b"], "(after c a b)")


@query(f"WITH p AS ({AFTER}), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations) x WHERE EXISTS (SELECT 1 FROM conversations y WHERE y.conv_id = x.conv_id AND y.turn > x.turn)) SELECT 'one' AS rule, (SELECT n FROM n) AS matches UNION ALL SELECT 'more', (SELECT count(*) FROM p) - (SELECT n FROM n)")
def traced_rule_matches(spark, d):
    """Matches by rule: semi-naive, so each pair of facts is met once."""
    p = Program(spark, trace=True)
    p.run(TURNS)
    p.load("next", turns(spark, d))
    p.saturate()
    return p.traced_matches().groupBy("rule").agg(F.count(F.lit(1)).alias("matches"))


@query("SELECT user_id AS u, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def host_rule(spark, d):
    """The head of a rule is a function over all its matches at once."""
    p = program(spark, "(relation event (i64 i64 String)) (function n (i64 String) i64 :merge new)", event=table(spark, d, "events").select("event_id", "user_id", "event_type"))
    p.host_rule("(event e u k)", lambda m: {"n": m.groupBy("u", "k").agg(F.count(F.lit(1)))}, naive=True)
    p.run("(run 1)")
    return p.query(["u", "kind", "n"], "(= n (n u kind))")


@query("SELECT c_custkey AS c, c_nationkey::BIGINT AS n, 'gone' AS which FROM customer WHERE c_nationkey < 5 UNION ALL SELECT c_custkey, c_nationkey + 100, 'new' FROM customer WHERE c_nationkey < 5")
def state_difference(spark, d):
    """What a program's rules changed, against a copy that didn't run them."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    text = "(function lives (i64) i64 :merge new) (rule ((= k (lives c)) (< k 5)) ((set (lives c) (+ k 100))))"
    before, after = program(spark, text, lives=rows), program(spark, text, lives=rows)
    after.run("(run 1)")
    gone, new = before.difference_to(after)["lives"]
    named = lambda df, which: df.select(F.col("k0").alias("c"), F.col("ret").alias("n"), F.lit(which).alias("which"))
    return named(gone, "gone").unionByName(named(new, "new"))


@query("SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT'")
def drained(spark, d):
    """Notifications: rows that rules gave to a relation, taken out of it."""
    p = program(spark, '(relation placed (i64 i64 String)) (relation notice (i64)) (rule ((placed o c "1-URGENT")) ((notice c)))', placed=table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    p.run("(run 1)")
    rows = p.drain("notice").select(F.col("k0").alias("c"))
    return rows if p.size("notice") == 0 else rows.limit(0)


# -- ways to join -----------------------------------------------------------------------------


@query(ORACLES["self_join_triangle"])
def triangle_generic(spark, d):
    """A cyclic pattern, a variable at a time."""
    p = Program(spark, strategy="generic")
    p.run("(relation trade (i64 i64))")
    p.load("trade", trade(spark, d))
    return p.query(["a", "b", "c"], "(trade a b) (trade b c) (trade c a) (< a b) (< b c)")


@query(ORACLES["conj_join_3"])
def conj_join_3_reduced(spark, d):
    """An acyclic pattern, semi-joins first."""
    p = Program(spark, strategy="reduced")
    p.run("(relation lives (i64 i64)) (relation placed (i64 i64 String)) (relation item (i64 i64))")
    p.load("lives", table(spark, d, "customer").select("c_custkey", "c_nationkey"))
    p.load("placed", table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    p.load("item", table(spark, d, "lineitem").select("l_orderkey", "l_partkey"))
    return p.query(["n", "part"], '(lives c n) (placed o c "F") (item o part)')


@query("SELECT n_nationkey::BIGINT AS n, r_regionkey::BIGINT AS r FROM nation, region WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND c_nationkey = 3)")
def factored_query(spark, d):
    """Parts that share no variable: two are multiplied, one is only asked whether it holds."""
    p = program(
        spark,
        "(relation nation (i64)) (relation region (i64)) (relation placed (i64 f64)) (relation lives (i64 i64))",
        nation=table(spark, d, "nation").select("n_nationkey"),
        region=table(spark, d, "region").select("r_regionkey"),
        placed=table(spark, d, "orders").select("o_custkey", "o_totalprice"),
        lives=table(spark, d, "customer").select("c_custkey", "c_nationkey"),
    )
    return p.query(["n", "r"], "(nation n) (region r) (placed c price) (> price 1000.0) (lives c 3)")
