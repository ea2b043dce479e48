"""Keys that many rows share: what comes of them is spread over tasks, and no more rows are made than the result needs."""

import random

from pyspark.sql import functions as F

from lodestone.operators import dealing, fixpoint
from lodestone.operators.body import Runner
from lodestone.operators.decide import decide
from lodestone.sources.language import compile_text

PAIR = "define input In(Integer, Integer). define output Out(Integer, Integer, Integer). Out(n, a, b) :- In(a, n), In(b, n), a < b."


def largest(df):
    """The most rows of a task."""
    return df.groupBy(F.spark_partition_id().alias("at")).count().agg(F.max("count")).first()[0]


def test_pairs_of_a_key_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS", 16)
    monkeypatch.setattr(dealing, "PAIRS", 1_000)
    r = random.Random(2)
    given = [(k, r.choice([0, 0, 0, 0, 1, 2])) for k in range(200)] * 2
    out = decide(spark, compile_text(PAIR), {"In": spark.createDataFrame(given, "k long, n long")}).outputs["Out"]
    want = {(n, a, b) for a, n in given for b, m in given if n == m and a < b}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert largest(out) < len(want) / 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]  # nothing gathers the pairs once they are made


def test_rows_that_a_head_makes_equal_are_one(spark):
    given = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "a long, b long")
    real = spark.createDataFrame([(1, 0.0), (2, -0.0)], "a long, b double")
    out = lambda text, df: decide(spark, compile_text(text), {"In": df}).rows("Out")
    assert out("define input In(Integer, Integer). define output Out Integer. Out b :- In(a, b).", given) == [(5,), (6,)]
    assert out("define input In(Integer, Integer). define output Out Integer. Out c :- In(a, b), c = b / 2 + 0 * a.", given) == [(2,), (3,)]
    assert out("define input In(Integer, Integer). define output Out(Integer, Integer). Out(a, b) :- In(a, b) || In(b, a).", given) == [(1, 5), (2, 5), (3, 6), (5, 1), (5, 2), (6, 3)]
    assert [str(b) for _, b in out("define input In(Integer, Real). define output Out(Integer, Real). Out(a, c) :- In(a, b), c = -b.", real)] == ["0.0", "0.0"]


TESTS = {"t < s": lambda t, s: t < s, "t <= s": lambda t, s: t <= s, "t > s": lambda t, s: t > s, "t != s": lambda t, s: t != s, "!(t < s)": lambda t, s: t >= s, "s + 1 = t": lambda t, s: s + 1 == t, "t < s, t > 3": lambda t, s: 3 < t < s, "t < s + 2 || t = 9": lambda t, s: t < s + 2 or t == 9, "s > 2": lambda t, s: s > 2}


def test_what_only_has_to_exist(spark):
    r = random.Random(3)
    a, b = ({(r.randint(0, 12), r.randint(0, 3)) for _ in range(20)} for _ in range(2))
    frames = {n: spark.createDataFrame(sorted(x), "s long, n long") for n, x in (("A", a), ("B", b))}
    head = "define input A(Integer, Integer). define input B(Integer, Integer). define output Out(Integer, Integer). Out(n, s) :- "
    for text, test in TESTS.items():
        want = sorted({(n, s) for s, n in a for t, m in b if n == m and test(t, s)})
        for body in (f"A(s, n), B(t, n), {text}.", f"B(t, n), A(s, n), {text}."):
            assert decide(spark, compile_text(head + body), frames).rows("Out") == want, body
    assert decide(spark, compile_text(head + "A(s, n), B(t, m), t < s."), frames).rows("Out") == sorted({(n, s) for s, n in a if min(b)[0] < s})
    nan = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 2.0)], "k long, x double")
    text = "define input In(Integer, Real). define output Out Integer. Out k :- In(k, x), In(j, y), x < y."
    assert decide(spark, compile_text(text), {"In": nan}).rows("Out") == [(1,), (3,)]


def test_a_constraint_makes_a_row_for_each_term(spark):
    text = "define input In(Integer, Integer). define output decision Out(Integer, Integer). Out(n, s) :- In(s, n). constrain (n) = 1 :- Out(n, s). constrain (n, s) = 0 :- Out(n, s), In(t, n), t < s."
    program = compile_text(text)
    given = spark.range(300).selectExpr("id as c0", "id % 2 as c1")
    out = given.selectExpr("c1 as c0", "c0 as c1", "string(c0) as id")
    constraint = program.constraints[1]
    made = Runner(program, constraint.body, lambda n, _: {"In": given, "Out": out}[n], constraint.head, True).run()
    assert made.count() == 298  # by pairs: 22,350
    assert decide(spark, program, {"In": given}).rows("Out") == [(0, 0), (1, 1)]


def test_recursion_deals_out_common_keys(spark, monkeypatch):
    """All but the first few reach 1 and 0: those rows of theirs are no task's alone. Rounds of few rows count no keys."""
    monkeypatch.setattr(fixpoint, "_few", lambda *a: None)
    text = "define input In(Integer, Integer). define output Out(Integer, Integer). Out(p, q) :- In(p, q). Out(p, r) :- Out(p, q), Out(q, r)."
    given = spark.createDataFrame([(p, p // 2) for p in range(1, 200)], "p long, q long")
    want = sorted((p, p >> k) for p in range(1, 200) for k in range(1, p.bit_length() + 1))
    used = []
    monkeypatch.setattr("lodestone.operators.body.dealt", lambda *a, **b: used.append(dealing.dealt(*a, **b)) or used[-1])
    assert decide(spark, compile_text(text), {"In": given}).rows("Out") == want and not used
    for name, k in (("ROWS", 8), ("GATHERED", 100)):
        monkeypatch.setattr(dealing, name, k)
    monkeypatch.setattr(fixpoint, "MANY", 0)
    assert decide(spark, compile_text(text), {"In": given}).rows("Out") == want
    assert used and all(df.count() == 0 or largest(df) <= max(40, df.count() / 2) for df in used[:2])
