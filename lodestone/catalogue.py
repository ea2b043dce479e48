"""Registered queries of the decision engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.circuit import constraint_groups, support
from .operators.decide import Outcome, decide
from .operators.storage import folder
from .plans import ir
from .plans.validate import ProgramError, validate
from .sources import json_io, sexp
from .sources.language import compile_text
from .streaming.session import Session, SessionError

# relation: its definition, and the table and columns that fill it
TABLES = {
    "Nation": ("(Integer, String, Integer)", "nation", ["n_nationkey", "n_name", "n_regionkey"]),
    "Region": ("(Integer, String)", "region", ["r_regionkey", "r_name"]),
    "Customer": ("(Integer, Integer)", "customer", ["c_custkey", "c_nationkey"]),
    "Supplier": ("(Integer, Integer)", "supplier", ["s_suppkey", "s_nationkey"]),
    "Balance": ("(Integer, Real)", "supplier", ["s_suppkey", "s_acctbal"]),
    "Part": ("(Integer, Integer)", "part", ["p_partkey", "p_size"]),
    "Label": ("(Integer, String, String)", "part", ["p_partkey", "p_brand", "p_type"]),
    "Orders": ("(Integer, Integer)", "orders", ["o_orderkey", "o_custkey"]),
    "Line": ("(Integer, Integer, Integer)", "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]),
    "Price": ("(Integer, Integer, Real, Real)", "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"]),
    "Event": ("(Integer, Integer)", "events", ["event_id", "user_id"]),
    "Stamp": ("(Integer, Integer)", "events", ["event_id", "ts"]),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def program_of(text: str) -> tuple:
    """The program of a text that may use the TABLES, and the tables it uses."""
    used = [n for n in TABLES if f"{n}(" in text or f"{n} " in text]
    return compile_text("\n".join(f"define input {n} {TABLES[n][0]}." for n in used) + text), used


def run_text(spark: SparkSession, sf_dir: str, text: str) -> Outcome:
    program, used = program_of(text)
    inputs = {n: spark.read.parquet(f"{sf_dir}/{TABLES[n][1]}.parquet").select(*TABLES[n][2]) for n in used}
    return decide(spark, program, inputs)


def add(name: str, text: str, columns: str, sql: str, out: str = "Out") -> None:
    """A query whose result is an output relation, with its columns named."""
    QUERIES[name] = lambda spark, sf: run_text(spark, sf, text).outputs[out].toDF(*columns.split())
    ORACLES[name] = sql


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


I1, I2, I3 = "define output Out Integer.", "define output Out(Integer, Integer).", "define output Out(Integer, Integer, Integer)."

# Scans, filters, computed columns
add("scan_nation", "define output Out(Integer, String). Out(k, n) :- Nation(k, n, r).", "k n", "SELECT DISTINCT CAST(n_nationkey AS BIGINT) k, n_name n FROM nation")
add("const_scan", "define output Out(Integer, String). Out(k, n) :- Nation(k, n, 2).", "k n", "SELECT DISTINCT CAST(n_nationkey AS BIGINT) k, n_name n FROM nation WHERE n_regionkey = 2")
add("facts_values", "define Colour Symbol. Colour Red. Colour Blue. Colour Red. define output Out(Symbol, Integer). Out(c, -3) :- Colour c. Out(Green, 0).", "c n", "SELECT * FROM (VALUES ('Red', CAST(-3 AS BIGINT)), ('Blue', -3), ('Green', 0)) t(c, n)")
add("timestamp_scan", "define output Out(Integer, Integer). Out(e, t) :- Stamp(e, t).", "e t", "SELECT DISTINCT event_id e, epoch_us(ts) t FROM events")
add("filter_cmp", f"{I2} Out(p, s) :- Part(p, s), s >= 10, s < 20, p != 7.", "p s", "SELECT DISTINCT p_partkey p, CAST(p_size AS BIGINT) s FROM part WHERE p_size >= 10 AND p_size < 20 AND p_partkey <> 7")
add("let_arith", f"{I1} Out x :- Line(o, n, p), x = o * 10 + n.", "x", "SELECT DISTINCT l_orderkey * 10 + l_linenumber x FROM lineitem")
add("head_const", "define output Out(Symbol, Integer). Out(Land, k) :- Region(k, n).", "kind k", "SELECT 'Land' kind, CAST(r_regionkey AS BIGINT) k FROM region")
add("eq_assign", f"{I2} Out(o, x) :- Orders(o, c), o + c = x.", "o x", "SELECT DISTINCT o_orderkey o, o_orderkey + o_custkey x FROM orders")
add("conjunction", f"{I1} Out p :- Part(p, s), s > 5 && s < 9, p > 3.", "p", "SELECT DISTINCT p_partkey p FROM part WHERE p_size > 5 AND p_size < 9 AND p_partkey > 3")
add("tuple_cmp", f"{I2} Out(a, b) :- Nation(a, n, r), Nation(b, m, s), (a, r) < (b, s).", "a b", "SELECT DISTINCT CAST(x.n_nationkey AS BIGINT) a, CAST(y.n_nationkey AS BIGINT) b FROM nation x, nation y WHERE x.n_nationkey < y.n_nationkey AND x.n_regionkey < y.n_regionkey")
add("tuple_ne", f"{I2} Out(a, b) :- Nation(a, n, r), Nation(b, m, s), (a, r) != (b, s).", "a b", "SELECT DISTINCT CAST(x.n_nationkey AS BIGINT) a, CAST(y.n_nationkey AS BIGINT) b FROM nation x, nation y WHERE NOT (x.n_nationkey = y.n_nationkey AND x.n_regionkey = y.n_regionkey)")
add("tuple_destructure", "define Pair(Integer, (Integer, Integer)). Pair(r, (k, r)) :- Nation(k, n, r). define output Out(Integer, Integer). Out p :- Pair(r, p), r > 1.", "k r", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(n_regionkey AS BIGINT) r FROM nation WHERE n_regionkey > 1")
add("atom_expr", f"{I2} Out(e, u) :- Event(e, u), Event(e + 1, u).", "e u", "SELECT DISTINCT x.event_id e, x.user_id u FROM events x JOIN events y ON y.event_id = x.event_id + 1 AND x.user_id = y.user_id")
add("repeated_variable", f"{I1} Out k :- Supplier(k, k).", "k", "SELECT DISTINCT s_suppkey k FROM supplier WHERE s_suppkey = s_nationkey")

# Joins
add("natural_join", "define output Out(Integer, String). Out(c, m) :- Customer(c, n), Nation(n, m, r).", "c m", "SELECT DISTINCT c_custkey c, n_name m FROM customer JOIN nation ON c_nationkey = n_nationkey")
add("multiway_join", "define output Out(Integer, String, String). Out(c, m, g) :- Customer(c, n), Nation(n, m, r), Region(r, g).", "c m g", "SELECT DISTINCT c_custkey c, n_name m, r_name g FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("cross_join", f"{I2} Out(a, b) :- Region(a, x), Nation(b, y, z).", "a b", "SELECT DISTINCT CAST(r_regionkey AS BIGINT) a, CAST(n_nationkey AS BIGINT) b FROM region, nation")
add("self_join", f"{I3} Out(n, a, b) :- Supplier(a, n), Supplier(b, n), a < b.", "n a b", "SELECT DISTINCT CAST(x.s_nationkey AS BIGINT) n, x.s_suppkey a, y.s_suppkey b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey")
add("theta_join", f"{I2} Out(a, b) :- Nation(a, n, r), Supplier(b, m), a < m.", "a b", "SELECT DISTINCT CAST(n_nationkey AS BIGINT) a, s_suppkey b FROM nation, supplier WHERE n_nationkey < s_nationkey")
add("computed_key_join", f"{I3} Out(e, u, v) :- Event(e, u), f = e + 1, Event(f, v).", "e u v", "SELECT DISTINCT x.event_id e, x.user_id u, y.user_id v FROM events x JOIN events y ON y.event_id = x.event_id + 1")
add("semi_join", f"{I1} Out c :- Customer(c, n), Orders(o, c).", "c", "SELECT DISTINCT c_custkey c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
add("antijoin", f"define Big Integer. Big p :- Part(p, s), s >= 25. {I2} Out(o, p) :- Line(o, n, p), !Big p.", "o p", "SELECT DISTINCT l_orderkey o, l_partkey p FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size >= 25)")
add("antijoin_const", f"{I1} Out p :- Part(p, s), !Part(p, 10).", "p", "SELECT DISTINCT p_partkey p FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 10)")
add("line_part_join", f"{I3} Out(o, p, s) :- Line(o, n, p), Part(p, s), s > 45.", "o p s", "SELECT DISTINCT l_orderkey o, l_partkey p, CAST(p_size AS BIGINT) s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45")

# Sets
add("union_rules", f"{I1} Out n :- Customer(c, n). Out n :- Supplier(s, n).", "n", "SELECT CAST(c_nationkey AS BIGINT) n FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
add("union_bodies", f"{I1} Out n :- Part(n, s) :- Supplier(n, m) :- Customer(c, n).", "n", "SELECT CAST(p_partkey AS BIGINT) n FROM part UNION SELECT s_suppkey FROM supplier UNION SELECT CAST(c_nationkey AS BIGINT) FROM customer")
add("or_merge", f"{I1} Out k :- Customer(k, 3) || Supplier(k, 4).", "k", "SELECT c_custkey k FROM customer WHERE c_nationkey = 3 UNION SELECT s_suppkey FROM supplier WHERE s_nationkey = 4")
add("not_or", f"{I1} Out k :- Part(k, s), !(Part(k, 10) || s < 5).", "k", "SELECT DISTINCT p_partkey k FROM part WHERE p_size <> 10 AND p_size >= 5")
add("intersect", f"define A Integer. A c :- Customer(c, n). define B Integer. B c :- Orders(o, c). {I1} Out c :- A c, B c.", "c", "SELECT CAST(c_custkey AS BIGINT) c FROM customer INTERSECT SELECT CAST(o_custkey AS BIGINT) FROM orders")
add("difference", f"define A Integer. A p :- Part(p, s). define B Integer. B p :- Part(p, s), s < 12. {I1} Out p :- A p, !B p.", "p", "SELECT CAST(p_partkey AS BIGINT) p FROM part EXCEPT SELECT CAST(p_partkey AS BIGINT) FROM part WHERE p_size < 12")


@query("program_merge", "SELECT CAST(r_regionkey AS BIGINT) k FROM region UNION SELECT CAST(n_nationkey AS BIGINT) FROM nation UNION SELECT 99")
def program_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = program_of(f"{I1} Out k :- Region(k, n). Out 99.")
    b, _ = program_of(f"{I1} Out k :- Nation(k, n, r).")
    read = lambda n: spark.read.parquet(f"{sf_dir}/{TABLES[n][1]}.parquet").select(*TABLES[n][2])
    return decide(spark, a.merge(b), {n: read(n) for n in ("Region", "Nation")}).outputs["Out"].toDF("k")


# Scalars
add("int_div", f"{I3} Out(k, a, b) :- Nation(k, n, r), a = (k - 12) / 5, b = (k - 12) / -5.", "k a b", "SELECT CAST(n_nationkey AS BIGINT) k, CAST((n_nationkey - 12) // 5 AS BIGINT) a, CAST((n_nationkey - 12) // -5 AS BIGINT) b FROM nation")
add("int_ops", f"{I3} Out(k, a, b) :- Nation(k, n, r), a = -k * r - 3, b = 2 + r * r.", "k a b", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(-n_nationkey * n_regionkey - 3 AS BIGINT) a, CAST(2 + n_regionkey * n_regionkey AS BIGINT) b FROM nation")
add("real_ops", "define output Out(Integer, Integer, Real, Real). Out(o, l, x, y) :- Price(o, l, p, d), x = p - p * d, y = -p + d.", "o l x y", "SELECT DISTINCT l_orderkey o, CAST(l_linenumber AS BIGINT) l, l_extendedprice - l_extendedprice * l_discount x, -l_extendedprice + l_discount y FROM lineitem")
add("real_div0", "define output Out(Integer, Real, Boolean). Out(s, x, y) :- Balance(s, b), z = b - b, x = b / z, y = (z / z = z / z).", "s x y", "SELECT s_suppkey s, CASE WHEN s_acctbal > 0 THEN 'Infinity'::DOUBLE WHEN s_acctbal < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END x, TRUE y FROM supplier")
add("concat", "define output Out(Integer, String). Out(p, x) :- Label(p, b, t), x = b .. t .. b.", "p x", "SELECT DISTINCT p_partkey p, p_brand || p_type || p_brand x FROM part")
add("bool_ops", "define output Out(Integer, Boolean, Boolean). Out(p, x, y) :- Part(p, s), x = (s < 10 || s > 40), y = (!x && p > 100).", "p x y", "SELECT p_partkey p, p_size < 10 OR p_size > 40 x, NOT (p_size < 10 OR p_size > 40) AND p_partkey > 100 y FROM part")
add("str_cmp", "define output Out(String, String). Out(a, b) :- Nation(k, a, r), Nation(l, b, r), a < b.", "a b", "SELECT DISTINCT x.n_name a, y.n_name b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name")
add("cmp_all", "define output Out(Integer, Boolean, Boolean, Boolean, Boolean). Out(k, a, b, c, d) :- Nation(k, n, r), a = (k <= 12), b = (k >= 12), c = (k > 12), d = (k != 12).", "k a b c d", "SELECT CAST(n_nationkey AS BIGINT) k, n_nationkey <= 12 a, n_nationkey >= 12 b, n_nationkey > 12 c, n_nationkey <> 12 d FROM nation")
add("same_level", "define output Out Integer. Out k :- Nation(k, n, r), r = 1 || r = 2 && k > 9.", "k", "SELECT CAST(n_nationkey AS BIGINT) k FROM nation WHERE (n_regionkey = 1 OR n_regionkey = 2) AND n_nationkey > 9")

# Recursion
add("gen_range", f"{I1} Out 1. Out a :- Out b, b < 100, a = b + 1.", "n", "SELECT range AS n FROM range(1, 101)")
PARENTS = "define Up(Integer, Integer). Up(p, q) :- Part(p, s), p > 0, q = p / 2."
ANCESTORS = "WITH RECURSIVE up AS (SELECT p_partkey p, p_partkey // 2 q FROM part WHERE p_partkey > 0), t(p, q) AS (SELECT p, q FROM up UNION SELECT t.p, up.q FROM t JOIN up ON t.q = up.p) SELECT CAST(p AS BIGINT) p, CAST(q AS BIGINT) q FROM t"
add("ancestor", f"{PARENTS} {I2} Out(p, q) :- Up(p, q). Out(p, r) :- Out(p, q), Up(q, r).", "p q", ANCESTORS)
add("ancestor_nonlinear", f"{PARENTS} {I2} Out(p, q) :- Up(p, q). Out(p, r) :- Out(p, q), Out(q, r).", "p q", ANCESTORS)
RING = "define Next(Integer, Integer). Next(a, b) :- Nation(a, n, r), b = a + 1, a < 24. Next(24, 0)."
add("reach_cycle", f"{RING} {I2} Out(a, b) :- Next(a, b). Out(a, c) :- Out(a, b), Next(b, c).", "a b", "SELECT CAST(x.n_nationkey AS BIGINT) a, CAST(y.n_nationkey AS BIGINT) b FROM nation x, nation y")
add("mutual_even_odd", f"define Odd Integer. define Even Integer. Even 0. Odd a :- Even b, b < 50, a = b + 1. Even a :- Odd b, b < 50, a = b + 1. {I2} Out(0, a) :- Even a. Out(1, a) :- Odd a.", "odd n", "SELECT range % 2 AS odd, range AS n FROM range(0, 51)")
REACH = "define Reach Integer. Reach 0. Reach b :- Reach a, a < 15, b = a + 3."
add("strat_neg", f"{REACH} {I1} Out k :- Nation(k, n, r), !Reach k.", "k", "SELECT CAST(n_nationkey AS BIGINT) k FROM nation WHERE NOT (n_nationkey <= 15 AND n_nationkey % 3 = 0)")
add("two_strata", f"{REACH} define Far Integer. Far k :- Nation(k, n, r), !Reach k. {I1} Out k :- Nation(k, n, r), !Far k.", "k", "SELECT CAST(n_nationkey AS BIGINT) k FROM nation WHERE n_nationkey <= 15 AND n_nationkey % 3 = 0")

# NaN is a value, equal to itself and above all others; null is not in a relation.
@query("real_nan", "SELECT CAST(2 AS BIGINT) k UNION ALL SELECT 3")
def real_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, float("nan")), (4, None)], "k long, x double")
    return decide(spark, compile_text(f"define input In(Integer, Real). {I1} Out k :- In(k, x), In(j, x), j != k."), {"In": rows}).outputs["Out"].toDF("k")


# Decisions with one answer
add("dec_force_all", "define output decision Out Integer. Out k :- Nation(k, n, r). constrain (k) = 0 :- Nation(k, n, r), !Out k.", "k", "SELECT CAST(n_nationkey AS BIGINT) k FROM nation")
add("dec_forbid", "define output decision Out Integer. Out k :- Nation(k, n, r). constrain = 0 :- Out k, Nation(k, n, 2). constrain >= 20 :- Out k.", "k", "SELECT CAST(n_nationkey AS BIGINT) k FROM nation WHERE n_regionkey <> 2")
add("dec_unique_min", "define output decision Out(Integer, Integer). Out(n, s) :- Supplier(s, n). constrain (n) = 1 :- Out(n, s). constrain (n, s) = 0 :- Out(n, s), Supplier(t, n), t < s.", "n s", "SELECT CAST(s_nationkey AS BIGINT) n, min(s_suppkey) s FROM supplier GROUP BY s_nationkey")
SOFT = "define output decision Out(Integer, Integer). Out(r, k) :- Nation(k, n, r). define After(Integer, Integer). After(k, j) :- Nation(k, n, r), Nation(j, m, r), j < k. define First Integer. First k :- Nation(k, n, r), !Late k. define Late Integer. Late k :- After(k, j). constrain (r) = 1 :- Out(r, k). constrain (k) = 0 :- Out(r, k), First k. constrain soft(1) (k) = 0 :- Out(r, k), Late k. constrain soft(2) (k) = 0 :- Out(r, k), After(k, j), After(j, i)."
add("dec_soft_opt", SOFT, "r k", "SELECT CAST(n_regionkey AS BIGINT) r, CAST(n_nationkey AS BIGINT) k FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) i FROM nation) WHERE i = 2")
add("dec_conditional", "define decision Pick Integer. Pick k :- Nation(k, n, r). constrain = 0 :- Pick k, Nation(k, n, 1). constrain (k) = 0 :- Nation(k, n, 3), !Pick k. constrain (k) = 0 :- Nation(k, n, r), r != 3, Pick k. define output Out String. Out n :- Pick k, Nation(k, n, r).", "n", "SELECT n_name n FROM nation WHERE n_regionkey = 3")


@query("dec_soft_cost", "SELECT 'SAT' status, CAST(5 AS BIGINT) cost")
def dec_soft_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_text(spark, sf_dir, SOFT)
    return spark.createDataFrame([(found.status, found.cost)], "status string, cost long")


@query("dec_unsat", "SELECT 'UNSAT' status, CAST(0 AS BIGINT) n")
def dec_unsat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_text(spark, sf_dir, "define output decision Out Integer. Out k :- Region(k, n). constrain = 1 :- Out k. constrain >= 2 :- Out k.")
    return spark.createDataFrame([(found.status, found.outputs["Out"].count())], "status string, n long")


# A square of symbols: each place, row and column of regions has each once.
LATIN = "define output decision Put(Integer, Integer, Integer). Put(a, b, c) :- Region(a, x), Region(b, y), Region(c, z). constrain (a, b) = 1 :- Put(a, b, c). constrain (b, c) = 1 :- Put(a, b, c). constrain (a, c) <= 1 :- Put(a, b, c)."


@query("circuit_terms", "WITH r AS (SELECT CAST(r_regionkey AS BIGINT) k FROM region), g AS (SELECT x.k a, y.k b FROM r x, r y) SELECT CAST(range AS INT) cid, '{\"k0\":' || a || ',\"k1\":' || b || '}' grp, CAST(5 AS BIGINT) n FROM range(3), g")
def circuit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_text(spark, sf_dir, LATIN).terms.groupBy("cid", F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("circuit_support", "SELECT 'Out' relation, TRUE uncond, CAST(25 AS BIGINT) n UNION ALL SELECT 'Both', FALSE, 10")
def circuit_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "define output decision Out Integer. Out k :- Nation(k, n, r). define output Both Integer. Both r :- Out k, Nation(k, n, r). Both r :- Nation(k, n, q), !Out k, r = q + 10."
    return support(run_text(spark, sf_dir, text).implies).groupBy("relation", "uncond").agg(F.count(F.lit(1)).alias("n"))


@query("constraint_groups", "SELECT 'Only' kind, CAST(1 AS BIGINT) threshold, CAST(50 AS BIGINT) n UNION ALL SELECT 'AtMost', 1, 25")
def constraint_groups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    program, _ = program_of(LATIN)
    return constraint_groups(program, run_text(spark, sf_dir, LATIN).terms).groupBy("kind", "threshold").agg(F.count(F.lit(1)).alias("n"))


# One answer is as good as another here: what is checked is that it breaks nothing.
@query("latin_square", "SELECT 'SAT' status, CAST(25 AS BIGINT) n, CAST(25 AS BIGINT) places, CAST(25 AS BIGINT) in_rows, CAST(25 AS BIGINT) in_columns")
def latin_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_text(spark, sf_dir, LATIN)
    count = lambda *c: F.countDistinct(*c)
    return found.outputs["Put"].agg(F.lit(found.status).alias("status"), F.count(F.lit(1)).alias("n"), count("c0", "c1").alias("places"), count("c0", "c2").alias("in_rows"), count("c1", "c2").alias("in_columns"))


# As many queens as a board of seven takes: every empty place costs 1; a line of a kind holds one queen at most.
BOARD = """define Place(Integer, Integer). Place(r, c) :- Nation(r, n, g), Nation(c, m, h), r < 7, c < 7. define Ray(Integer, Integer, Integer, Integer).
Ray(0, r, r, c) :- Place(r, c). Ray(1, c, r, c) :- Place(r, c). Ray(2, d, r, c) :- Place(r, c), d = r + c. Ray(3, d, r, c) :- Place(r, c), d = r - c.
define output decision Queen(Integer, Integer). Queen(r, c) :- Place(r, c). constrain (kind, i) <= 1 :- Queen(r, c), Ray(kind, i, r, c). constrain soft(1) (r, c) = 1 :- Queen(r, c)."""


@query("most_queens", "SELECT 'SAT' status, CAST(42 AS BIGINT) cost, CAST(7 AS BIGINT) n, CAST(0 AS BIGINT) attacks")
def most_queens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_text(spark, sf_dir, BOARD)
    a, b = found.outputs["Queen"].toDF("r", "c"), found.outputs["Queen"].toDF("s", "d")
    attacks = a.join(b, ((F.col("r") < F.col("s")) | ((F.col("r") == F.col("s")) & (F.col("c") < F.col("d")))) & ((F.col("r") == F.col("s")) | (F.col("c") == F.col("d")) | (F.abs(F.col("c") - F.col("d")) == F.col("s") - F.col("r"))))
    return spark.createDataFrame([(found.status, found.cost, a.count(), attacks.count())], "status string, cost long, n long, attacks long")


# Every part goes into one bin that is large enough; bins double. A fact has many candidates, and all groups are free.
BINS = "define Bin Integer. Bin 1. Bin b :- Bin a, a < 64, b = a * 2. define output decision In(Integer, Integer). In(p, b) :- Part(p, s), Bin b, s <= b. constrain (p) = 1 :- In(p, b)."


@query("part_bins", "SELECT 'SAT' status, count(*) n, count(*) parts, CAST(0 AS BIGINT) too_small FROM part")
def part_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_text(spark, sf_dir, BINS)
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("c0"), F.col("p_size").alias("s"))
    return found.outputs["In"].join(sizes, "c0").agg(F.lit(found.status).alias("status"), F.count(F.lit(1)).alias("n"), F.countDistinct("c0").alias("parts"), F.sum(F.expr("cast(s > c1 as long)")).alias("too_small"))


# One part of all is picked: a group that holds the whole table.
add("pick_one_part", "define output decision Out Integer. Out p :- Part(p, s). constrain = 1 :- Out p. define output Any Integer. Any 1.", "one", "SELECT CAST(1 AS BIGINT) one", "Any")


@query("pick_one_count", "SELECT 'SAT' status, CAST(1 AS BIGINT) n")
def pick_one_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_text(spark, sf_dir, "define output decision Out Integer. Out p :- Part(p, s). constrain = 1 :- Out p.")
    return found.outputs["Out"].agg(F.lit(found.status).alias("status"), F.count(F.lit(1)).alias("n"))


# A map of nations in three inks; neighbours differ. The constraint counts pairs of decisions.
INKS = """define Ink Symbol. Ink Red. Ink Sea. Ink Sun. define Near(Integer, Integer). Near(a, b) :- Nation(a, n, r), b = a + 1, Nation(b, m, s). Near(a, b) :- Nation(a, n, r), b = a + 5, Nation(b, m, s).
define output decision Tint(Integer, Symbol). Tint(a, i) :- Nation(a, n, r), Ink i. constrain (a) = 1 :- Tint(a, i). constrain (i) = 0 :- Near(a, b), Tint(a, i), Tint(b, i)."""


@query("map_inks", "SELECT 'SAT' status, CAST(25 AS BIGINT) n, CAST(0 AS BIGINT) clashes")
def map_inks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_text(spark, sf_dir, INKS)
    a = found.outputs["Tint"].toDF("a", "i")
    clashes = sum(a.join(a.select((F.col("a") + d).alias("a"), "i"), ["a", "i"]).count() for d in (1, 5))
    return spark.createDataFrame([(found.status, a.count(), clashes)], "status string, n long, clashes long")


# The fewest links of a grid of nations to cut, so that the last can't be reached: recursion through what is decided.
GRID = """define Link(Integer, Integer). Link(a, b) :- Nation(a, n, r), b = a + 5, Nation(b, m, s). Link(a, b) :- Nation(a, n, r), b = a + 1, Nation(b, m, s), x = a / 5, x = b / 5.
define output decision Cut(Integer, Integer). Cut(a, b) :- Link(a, b). constrain soft(1) (a, b) = 0 :- Cut(a, b).
define output Reach Integer. Reach 0. Reach b :- Reach a, Link(a, b), !Cut(a, b). constrain = 0 :- Reach 24."""


@query("min_cut", "SELECT 'SAT' status, CAST(2 AS BIGINT) cost, CAST(2 AS BIGINT) cuts, FALSE reached")
def min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_text(spark, sf_dir, GRID)
    return spark.createDataFrame([(found.status, found.cost, found.outputs["Cut"].count(), found.outputs["Reach"].where("c0 = 24").count() > 0)], "status string, cost long, cuts long, reached boolean")


# Sessions
PASS = "define input In(Integer, Integer). define output Out Integer. Out u :- In(e, u), e > 10."


def _session(spark: SparkSession, sf_dir: str) -> tuple[Session, DataFrame]:
    session = Session(spark)
    session.set_program(compile_text(PASS))
    return session, spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")


@query("sess_insert_remove", "SELECT DISTINCT user_id u FROM events WHERE event_id > 10 AND user_id % 3 <> 0")
def sess_insert_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, rows = _session(spark, sf_dir)
    session.update_input("In", rows)
    session.update_input("In", rows.where("user_id % 3 = 0"), state=False)
    return session.get_tuples("Out").toDF("u")


@query("sess_clear", "SELECT CAST(77 AS BIGINT) u")
def sess_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, rows = _session(spark, sf_dir)
    session.update_input("In", rows)
    session.clear_input("In")
    session.get_input("In").insert((11, 77), (5, 1))
    return session.get_tuples("Out").toDF("u")


@query("sess_watch", "SELECT user_id % 3 = 2 came, user_id u FROM events WHERE event_id > 10 AND user_id % 3 <> 1 GROUP BY user_id")
def sess_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, rows = _session(spark, sf_dir)
    session.update_input("In", rows.where("user_id % 3 < 2"))
    key = session.watch("Out")
    session.changes(key)
    tx = session.begin()
    session.update_input("In", rows.where("user_id % 3 = 0"), False, tx)
    session.update_input("In", rows.where("user_id % 3 = 2"), True, tx)
    session.commit(tx)
    return session.changes(key).toDF("came", "u")


@query("sess_check_tuples", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), TRUE), (1, FALSE)) t(i, held)")
def sess_check_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, _ = _session(spark, sf_dir)
    session.get_input("In").insert((1, 2))
    return spark.createDataFrame(list(enumerate(session.check_tuples("In", [(1, 2), (2, 1)]))), "i long, held boolean")


@query("sess_relations", "SELECT * FROM (VALUES ('In', TRUE), ('Out', FALSE)) t(name, is_input)")
def sess_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir)[0].list_relations().select("name", "is_input")


@query("text_sink", "SELECT 'Out(' || n_nationkey || ', (' || n_regionkey || ', \"' || n_name || '\")).' line FROM nation")
def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.text import lines

    text = "define output Out(Integer, (Integer, String)). Out(k, (r, n)) :- Nation(k, n, r)."
    program, _ = program_of(text)
    return lines(run_text(spark, sf_dir, text).outputs["Out"], program.relations["Out"])


# What is refused, each kind by the text or the body that brings it about
REFUSED = {
    "SyntaxError": "define A Integer. A 1", "DuplicateDefinition": "define A Integer. define A Symbol.", "UndefinedRelation": "Nowhere 1.", "UnknownType": "define A Colour.", "TypeMismatch": "define A Integer. define B Symbol. A x :- B x.",
    "TupleSize": "define A (Integer, Integer). A (1, 2, 3).", "RecursiveType": "define A A.", "UnboundVariable": "define A Integer. define B Integer. A x :- B y.", "UnassignedVariables": "define A Integer. define B Integer. A x :- B y, x < y.",
    "FactWithVariable": "define A Integer. A x.", "InputOutput": "define input output A Integer.", "NonMonotonicCycle": "define A Integer. define B Integer. A x :- B x, !A x.",
}


def refusal(f) -> str:
    """The kind of error that f raises, or none."""
    try:
        f()
    except (ProgramError, SessionError) as e:
        return e.kind
    return "none"


def _refused(name: str, make) -> None:
    QUERIES[f"refuse_{name}"] = lambda spark, sf: spark.createDataFrame([(refusal(lambda: make(spark)),)], "kind string")
    ORACLES[f"refuse_{name}"] = f"SELECT '{name.split('_')[0]}' kind"


for _kind, _text in REFUSED.items():
    _refused(_kind, lambda spark, text=_text: compile_text(text))


def _bodied(instructions, kinds=("Integer", "Integer"), loaded=("A",)) -> ir.Program:
    return ir.Program({"A": ir.Relation("A", "Integer"), "B": ir.Relation("B", "Integer", rules=[ir.Rule((0,), ir.Body(kinds, loaded, instructions))])})


_scan = ir.FromQuery(0, (0,))
for _kind, _program in {
    "Noop": _bodied(ir.Noop()), "Sink": _bodied(ir.Sink((0,), _scan)), "InvalidRelationIndex": _bodied(ir.FromQuery(3, (0,))), "InvalidVariableIndex": _bodied(ir.FromQuery(0, (9,))), "QuerySizeMismatch": _bodied(ir.FromQuery(0, (0, 1))),
    "ExpectedType": _bodied(_scan, ("String",)), "VariableAssignedTwice": _bodied(ir.Let(0, ir.Value("Integer", 1), _scan)), "MergeVariableMismatch": _bodied(ir.Merge(_scan, ir.FromQuery(0, (1,)))), "RelationNotFound": _bodied(_scan, loaded=("Z",)), "UnusedRelations": _bodied(_scan, loaded=("A", "B")),
}.items():
    _refused(_kind, lambda spark, program=_program: validate(program))


def _held(spark: SparkSession) -> Session:
    session = Session(spark)
    session.set_program(compile_text(PASS))
    return session


def _conflict(session: Session) -> None:
    tx = session.begin()
    session.update_input("In", [(True, (20, 1))], tx=tx)
    session.clear_input("In")
    session.commit(tx)


for _kind, _call in {
    "NoProgramLoaded": lambda spark: Session(spark).get_program(), "NoSuchRelation": lambda spark: _held(spark).get_input("Out"), "TypeMismatch_value": lambda spark: _held(spark).get_input("In").insert(("a", 1)),
    "InvalidProgram": lambda spark: Session(spark).set_program(_bodied(ir.Noop())), "UnknownTransaction": lambda spark: _held(spark).commit("none"), "ExistingTransaction": lambda spark: [s := _held(spark), s.begin("t"), s.begin("t")],
    "UnknownSubscription": lambda spark: _held(spark).changes("none"), "ExistingSubscription": lambda spark: [s := _held(spark), s.watch("In", "w"), s.watch("In", "w")], "Conflict": lambda spark: _conflict(_held(spark)),
}.items():
    _refused(_kind, _call)


@query("round_trips", "SELECT * FROM (VALUES ('sexp', TRUE), ('json', TRUE)) t(format, equal)")
def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = [program_of(t)[0] for t in (LATIN, BOARD, GRID, INKS, SOFT, PARENTS + I1 + " Out p :- Up(p, q).")]
    return spark.createDataFrame([(n, all(f.loads(f.dumps(p)) == p for p in programs)) for n, f in (("sexp", sexp), ("json", json_io))], "format string, equal boolean")


@query("sess_program_swap", "SELECT 1 AS step, 'Out' name, CAST(2 AS BIGINT) epoch UNION ALL SELECT 2, 'Other', 3")
def sess_program_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs are told back as they were set; a swap empties the inputs and each change counts one epoch."""
    session, rows, out = Session(spark), [(11, 5)], []
    session.set_program(compile_text(PASS))
    session.update_input("In", [(True, r) for r in rows])
    out.append((1, next(n for n, r in session.get_program().relations.items() if r.io == "Output"), session.epoch))
    session.set_program(compile_text(PASS.replace("Out", "Other")))
    if not session.values("Other"):
        out.append((2, next(n for n, r in session.get_program().relations.items() if r.io == "Output"), session.epoch))
    return spark.createDataFrame(out, "step int, name string, epoch long")


@query("sess_save_load", "SELECT DISTINCT user_id u FROM events WHERE event_id > 10")
def sess_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, rows = _session(spark, sf_dir)
    session.update_input("In", rows)
    path = folder(spark, "session")
    session.save(path)
    return Session.load(spark, path).get_tuples("Out").toDF("u")


@query("sess_output_update", "SELECT 'n' || n_regionkey step, CAST(count(*) AS BIGINT) n FROM nation WHERE n_regionkey < 2 GROUP BY n_regionkey")
def sess_output_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions follow their inputs: all that may hold must, so that the answer is one."""
    session = Session(spark)
    session.set_program(compile_text("define input In Integer. define output decision Out Integer. Out k :- In k. constrain (k) = 0 :- In k, !Out k."))
    out, nation = [], spark.read.parquet(f"{sf_dir}/nation.parquet")
    for r in range(2):
        session.clear_input("In")
        session.update_input("In", nation.where(F.col("n_regionkey") == r).select("n_nationkey"))
        out.append((f"n{r}", session.get_tuples("Out").count()))
    return spark.createDataFrame(out, "step string, n long")


@query("dec_unconditional", "SELECT 'SAT' status, CAST(25 AS BIGINT) n")
def dec_unconditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that need no decision are not counted: the second constraint has no others, and so asks for nothing."""
    found = run_text(spark, sf_dir, "define output decision Out Integer. Out k :- Nation(k, n, r). constrain = 25 :- Out k. constrain = 0 :- Nation(k, n, r).")
    return spark.createDataFrame([(found.status, found.outputs["Out"].count())], "status string, n long")
