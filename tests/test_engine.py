import itertools
import json
import random

import pytest

from lodestone.operators import fixpoint, small
from lodestone.operators.decide import decide
from lodestone.operators.solver import Problem, solve
from lodestone.plans import ir
from lodestone.plans.validate import ProgramError, validate
from lodestone.sources import json_io, sexp
from lodestone.sources.language import compile_text
from lodestone.streaming.session import Session, SessionError

BASE = "define Base Integer. Base 4. Base 5. Base 6. "


def rows(spark, text, name="Out", **inputs):
    return decide(spark, compile_text(text), inputs).rows(name)


def cost_of(problem, on):
    """A model's cost, or None if it breaks a rule."""
    holds = lambda t: (t[2:] in on) == (t[0] == "F")
    for fact, kind, free, ders in problem.facts:
        derived = any(all(map(holds, d)) for d in ders)
        if kind == "Conditional" and (fact in on) != (free or derived) or kind == "Decision" and fact in on and not free and not derived:
            return None
    cost = 0
    for kind, k, weight, terms in problem.groups:
        n = sum(all(map(holds, t)) for t in terms)
        if not {"Only": n == k, "AtMost": n <= k, "AtLeast": n >= k}[kind]:
            if weight is None:
                return None
            cost += weight
    return cost


def test_solver_finds_the_optimum():
    r = random.Random(1)
    for _ in range(800):
        names = [f"x{i}" for i in range(r.randint(1, 7))]
        lit = lambda: r.choice("FN") + ":" + r.choice(names)
        facts = [(x, r.choice(["Decision", "Decision", "Conditional"]), r.random() < 0.5, [[lit() for _ in range(r.randint(1, 2))] for _ in range(r.randint(0, 2))]) for x in names]
        groups = []
        for _ in range(r.randint(1, 6)):
            terms = {tuple(lit() for _ in range(r.randint(1, 2))) for _ in range(r.randint(1, 5))}
            groups.append((r.choice(["Only", "AtMost", "AtLeast"]), r.randint(0, 3), r.choice([None, 1, 2, 5]), [list(t) for t in sorted(terms)]))
        problem = Problem(facts, groups)
        costs = [c for bits in itertools.product([0, 1], repeat=len(names)) if (c := cost_of(problem, {x for x, b in zip(names, bits) if b})) is not None]
        found = solve(problem)
        assert (found.status, found.cost) == (("SAT", min(costs)) if costs else ("UNSAT", 0))
        assert not costs or cost_of(problem, set(found.true)) == found.cost


STOCK = "define Stock(Integer, Symbol). Stock(10, Oak). Stock(20, Elm). Stock(30, Oak). "


def test_denials_of_facts_and_of_decisions(spark):
    assert rows(spark, STOCK + "define Sold(Integer, Symbol). Sold(20, Elm). define output Out Integer. Out n :- Stock(n, t), !Sold(n, t).") == [(10,), (30,)]
    # whatever isn't kept breaks a rule, so all oak is kept, and elm may go
    text = STOCK + "define output decision Keep Integer. Keep n :- Stock(n, t). constrain (n) = 0 :- Stock(n, Oak), !Keep n. constrain = 0 :- Keep n, Stock(n, Elm)."
    assert rows(spark, text, "Keep") == [(10,), (30,)]


def test_order_of_terms_counts(spark):
    # (a, b) and (b, a) are two conditions, so two that are kept make two terms
    text = STOCK + "define output decision Keep Integer. Keep n :- Stock(n, t). constrain <= 1 :- Keep a, Keep b, a < b || b < a. constrain >= 2 :- Keep a."
    assert decide(spark, compile_text(text)).status == "UNSAT"


def test_bounded_search_keeps_the_best_model():
    """A limit on conflicts never turns a model into nothing."""
    n = 9
    facts = [(f"q{r}{c}", "Decision", True, []) for r in range(n) for c in range(n)]
    lines = {}
    for r in range(n):
        for c in range(n):
            for key in (("r", r), ("c", c), ("s", r + c), ("d", r - c)):
                lines.setdefault(key, []).append([f"F:q{r}{c}"])
    groups = [("AtMost", 1, None, t) for t in lines.values()] + [("AtLeast", 1, 1, [[f"F:q{r}{c}"]]) for r in range(n) for c in range(n)]
    seen = {solve(Problem(facts, groups), conflicts).status for conflicts in (1, 3, 10, 100, None)}
    assert seen <= {"SAT", "FEASIBLE", "UNKNOWN"} and "SAT" in seen
    best = solve(Problem(facts, groups))
    assert best.cost == n * n - n and len(best.true) == n


def test_one_group_of_many(spark):
    """A global group of a hundred thousand candidates needs no search and no row that holds it all."""
    many = spark.range(100_000).selectExpr("id as k")
    text = "define input In Integer. define output decision Out Integer. Out k :- In k. constrain = {} :- Out k."
    for k in (1, 3):
        found = decide(spark, compile_text(text.format(k)), {"In": many})
        assert (found.status, found.outputs["Out"].count()) == ("SAT", k)


def test_nan_rows_stay(spark):
    given = spark.createDataFrame([(0, 0.0), (1, float("nan")), (2, None)], "k long, x double")
    assert rows(spark, "define input In(Integer, Real). define output Out Integer. Out k :- In(k, x).", In=given) == [(0,), (1,)]


def test_spark_and_driver_fixpoints_agree(spark, monkeypatch):
    text = "define Edge(Integer, Integer). " + " ".join(f"Edge({a}, {b})." for a, b in [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)])
    text += " define output Out(Integer, Integer). Out(a, b) :- Edge(a, b). Out(a, c) :- Out(a, b), Out(b, c). define output Not(Integer, Integer). Not(a, b) :- Edge(a, x), Edge(y, b), !Out(a, b)."
    first = {n: rows(spark, text, n) for n in ("Out", "Not")}
    monkeypatch.setattr(fixpoint, "SMALL", -1)
    monkeypatch.setattr(fixpoint, "_few", lambda *a: None)
    assert {n: rows(spark, text, n) for n in ("Out", "Not")} == first
    assert len(first["Out"]) == 13


def test_fixpoints_agree_on_nan(spark, monkeypatch):
    text = """define input In(Integer, Real). define input No Real. define output Out(Integer, Real). Out(k, x) :- In(k, x). Out(k, y) :- Out(k, x), y = x + x - x, y = y.
    Out(j, z) :- Out(k, x), In(j, x), z = x, k < 100. Out(k, z) :- Out(k, x), In(j, y), x <= y, z = y * y / y. define output Big(Integer, Real). Big(k, x) :- In(k, x). Big(k, x) :- Big(j, y), In(k, x), y < x, !No x."""
    given = [(1, float("nan")), (2, float("nan")), (3, 2.0), (4, float("inf"))]
    make = lambda: {"In": spark.createDataFrame(given, "k long, x double"), "No": spark.createDataFrame([(float("nan"),)], "x double")}
    # as text, for rows with NaN don't compare
    first = {n: sorted(map(repr, rows(spark, text, n, **make()))) for n in ("Out", "Big")}
    monkeypatch.setattr(fixpoint, "_few", lambda *a: None)
    assert {n: sorted(map(repr, rows(spark, text, n, **make()))) for n in ("Out", "Big")} == first
    assert "(3, nan)" in first["Out"]


def test_divergence_is_an_error(spark):
    with pytest.raises((RecursionError, small.TooLarge)):
        fixpoint.possible(spark, compile_text("define output Out Integer. Out 1. Out a :- Out b, a = b + 1."), {}, rounds=5)


@pytest.mark.parametrize(
    "text,kind",
    [
        ("define A Integer. A x.", "FactWithVariable"), ("define A Integer. define A Integer.", "DuplicateDefinition"), ("A 1.", "UndefinedRelation"), ("define A Thing.", "UnknownType"),
        ("define A A.", "RecursiveType"), ("define input output A Integer.", "InputOutput"), ("define A Integer. define B Integer. A x :- B x, !A x.", "NonMonotonicCycle"),
        ("define A Integer. define B Symbol. A x :- B x.", "TypeMismatch"), ("define A Integer. define B Integer. A x :- B y.", "UnboundVariable"), ("define A Integer. A 1", "SyntaxError"),
        ("define A (Integer, Integer). A (1, 2, 3).", "TupleSize"), ("define A Integer. define B Integer. A x :- B y, x < y.", "UnassignedVariables"), ("import Std.Thing", "UnknownImport"),
    ],
)
def test_diagnostics(text, kind):
    with pytest.raises(ProgramError) as e:
        compile_text(text)
    assert e.value.kind == kind


def body(instructions, types=("Integer", "Integer"), loaded=("A",)):
    return ir.Body(tuple(types), tuple(loaded), instructions)


@pytest.mark.parametrize(
    "b,kind",
    [
        (body(ir.Noop()), "Noop"), (body(ir.Sink((0,), ir.FromQuery(0, (0,)))), "Sink"), (body(ir.FromQuery(3, (0,))), "InvalidRelationIndex"), (body(ir.FromQuery(0, (9,))), "InvalidVariableIndex"),
        (body(ir.FromQuery(0, (0, 1))), "QuerySizeMismatch"), (body(ir.FromQuery(0, (0,)), ("String",)), "ExpectedType"), (body(ir.FromQuery(0, (1,))), "UnassignedVariables"),
        (body(ir.Let(0, ir.Value("Integer", 1), ir.FromQuery(0, (0,)))), "VariableAssignedTwice"), (body(ir.Merge(ir.FromQuery(0, (0,)), ir.FromQuery(0, (1,)))), "MergeVariableMismatch"),
        (body(ir.Filter(ir.Binary("Add", ir.Var(0), ir.Value("Real", 1.0)), ir.FromQuery(0, (0,)))), "InvalidBinaryOp"), (body(ir.Filter(ir.Unary("Not", ir.Var(0)), ir.FromQuery(0, (0,)))), "InvalidUnaryOp"),
        (body(ir.FromQuery(0, (0,)), loaded=("A", "A")), "DuplicateRelationUserdata"), (body(ir.FromQuery(0, (0,)), loaded=("Z",)), "RelationNotFound"), (body(ir.FromQuery(0, (0,)), loaded=("A", "B")), "UnusedRelations"),
    ],
)
def test_validation(b, kind):
    program = ir.Program({"A": ir.Relation("A", "Integer"), "B": ir.Relation("B", "Integer", rules=[ir.Rule((0,), b)])})
    with pytest.raises(ProgramError) as e:
        validate(program)
    assert e.value.kind == kind


def test_interchange_round_trips():
    text = BASE + 'define Pair(Symbol, (Integer, Integer)). Pair(Up, (x, y)) :- Base x, Base y, (x < y || !Base 7), !Base y. define output decision Out Integer. Out x :- Pair(k, (x, y)). constrain soft(3) (x) >= 1 :- Out x, z = x / 2 + -x * 3.'
    program = compile_text(text)
    program.relations["Odd"] = ir.Relation("Odd", ("String", "Real", "Boolean"), facts=[(ir.Value("String", 'a "b"\\\n'), ir.Value("Real", -0.5), ir.Value("Boolean", True))])
    for io in (sexp, json_io):
        assert io.loads(io.dumps(program)) == program
        assert io.dumps(io.loads(io.dumps(program))) == io.dumps(program)
    assert json.loads(json_io.dumps(program))["constraints"][0]["weight"] == {"Soft": 3}
    assert program.map_relations(str.upper).map_relations(lambda n: {r.upper(): r for r in program.relations}[n]) == program
    assert program.merge(program) == program


def test_aliases_sigils_and_comments(spark):
    text = "; a comment\ntype Day = Integer\ndefine output Out(Day, (Symbol,)).\nOut(3, (Mon,)).\nOut(-2, (Tue,))."
    assert rows(spark, text) == [(-2, "Tue"), (3, "Mon")]


def session(spark):
    out = Session(spark)
    out.set_program(compile_text("define input In String. define output Out String. Out x :- In x."))
    return out


def test_session(spark, tmp_path):
    with pytest.raises(SessionError, match="NoProgramLoaded"):
        Session(spark).get_program()
    s = session(spark)
    given = s.get_input("In")
    given.insert("test", "test", "more")
    given.remove("absent", "more")
    assert s.get_output("Out").get_all() == ["test"] == given.get_all()
    assert s.check_tuples("In", ["test", "no", "test"]) == [True, False, True]
    for call, kind in [(lambda: s.get_input("Out"), "NoSuchRelation"), (lambda: given.insert(47), "TypeMismatch"), (lambda: s.commit("?"), "UnknownTransaction"), (lambda: s.changes("?"), "UnknownSubscription")]:
        with pytest.raises(SessionError) as e:
            call()
        assert e.value.kind == kind
    with pytest.raises(SessionError, match="InvalidProgram"):
        s.set_program(ir.Program({"X": ir.Relation("X", "String", facts=[(ir.Value("Integer", 0),)])}))
    a, b = s.begin(), s.begin()
    s.update_input("In", [(True, "a")], tx=a)
    assert given.get_all() == ["test"]
    s.update_input("In", [(True, "b")], tx=b)
    assert s.commit(a) == s.epoch
    with pytest.raises(SessionError, match="Conflict"):
        s.commit(b)
    assert s.values("Out") == ["a", "test"]
    key = s.watch("Out")
    assert s.changes(key).count() == 2
    given.remove("a")
    assert [tuple(r) for r in s.changes(key).collect()] == [(False, "a")]
    s.save(f"file://{tmp_path}/s")
    assert Session.load(spark, f"file://{tmp_path}/s").values("Out") == ["test"]
    s.clear_input("In")
    assert s.values("Out") == []
    assert [r.line for r in Session.load(spark, f"file://{tmp_path}/s").lines("Out").collect()] == ['Out "test".']


def test_stream_into_session(spark, tmp_path):
    s = session(spark)
    spark.createDataFrame([(True, "x"), (True, "y")], "state boolean, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("state boolean, v string").parquet(str(tmp_path / "in")).writeStream.foreachBatch(s.batch_writer("In")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination()
    assert s.values("Out") == ["x", "y"]


def test_program_facts_survive_removal(spark):
    s = Session(spark)
    s.set_program(compile_text("define input In Integer. In 1. define output Out Integer. Out x :- In x."))
    s.get_input("In").insert(1, 2)
    s.get_input("In").remove(1, 2)
    assert s.values("Out") == [1]
