"""Programs as JSON: externally tagged objects."""

from __future__ import annotations

import json
from typing import Any

from ..plans import ir
from ..plans.validate import ProgramError


def _type(x: Any) -> ir.Type:
    return x["Primitive"] if "Primitive" in x else tuple(map(_type, x["Tuple"]))


def _type_out(t: ir.Type) -> dict:
    return {"Primitive": t} if isinstance(t, str) else {"Tuple": [_type_out(p) for p in t]}


def _value(x: dict) -> ir.Value:
    ((kind, v),) = x.items()
    return ir.Value(kind, float(v) if kind == "Real" else v)


def _value_out(v: ir.Value) -> dict:
    return {v.type: v.value}


def _term(x: dict) -> ir.Term:
    return x["Variable"] if "Variable" in x else _value(x["Value"])


def _term_out(t: ir.Term) -> dict:
    return {"Value": _value_out(t)} if isinstance(t, ir.Value) else {"Variable": t}


def _expr(x: dict) -> Any:
    ((tag, v),) = x.items()
    match tag:
        case "Variable":
            return ir.Var(v)
        case "Value":
            return _value(v)
        case "Load":
            return ir.Load(v["relation"], tuple(map(_term, v["query"])))
        case "UnaryOp":
            return ir.Unary(v["op"], _expr(v["term"]))
        case "BinaryOp":
            return ir.Binary(v["op"], _expr(v["lhs"]), _expr(v["rhs"]))
    raise ProgramError("SyntaxError", f"unknown expression {tag}")


def _expr_out(e: Any) -> dict:
    match e:
        case ir.Var():
            return {"Variable": e.index}
        case ir.Value():
            return {"Value": _value_out(e)}
        case ir.Load():
            return {"Load": {"relation": e.relation, "query": [_term_out(t) for t in e.terms]}}
        case ir.Unary():
            return {"UnaryOp": {"op": e.op, "term": _expr_out(e.term)}}
    return {"BinaryOp": {"op": e.op, "lhs": _expr_out(e.lhs), "rhs": _expr_out(e.rhs)}}


def _node(x: Any) -> Any:
    if x == "Noop":
        return ir.Noop()
    ((tag, v),) = x.items()
    match tag:
        case "Sink":
            return ir.Sink(tuple(v["vars"]), _node(v["rest"]))
        case "FromQuery":
            return ir.FromQuery(v["relation"], tuple(map(_term, v["terms"])))
        case "Filter":
            return ir.Filter(_expr(v["test"]), _node(v["rest"]))
        case "Let":
            return ir.Let(v["var"], _expr(v["expr"]), _node(v["rest"]))
        case "Join":
            return ir.Join(_node(v["lhs"]), _node(v["rhs"]))
        case "Merge":
            return ir.Merge(_node(v["lhs"]), _node(v["rhs"]))
        case "Antijoin":
            return ir.Antijoin(v["relation"], tuple(map(_term, v["terms"])), _node(v["rest"]))
    raise ProgramError("SyntaxError", f"unknown instruction {tag}")


def _node_out(n: Any) -> Any:
    match n:
        case ir.Noop():
            return "Noop"
        case ir.Sink():
            return {"Sink": {"vars": list(n.vars), "rest": _node_out(n.rest)}}
        case ir.FromQuery():
            return {"FromQuery": {"relation": n.relation, "terms": [_term_out(t) for t in n.terms]}}
        case ir.Filter():
            return {"Filter": {"test": _expr_out(n.test), "rest": _node_out(n.rest)}}
        case ir.Let():
            return {"Let": {"var": n.var, "expr": _expr_out(n.expr), "rest": _node_out(n.rest)}}
        case ir.Join() | ir.Merge():
            return {type(n).__name__: {"lhs": _node_out(n.lhs), "rhs": _node_out(n.rhs)}}
    return {"Antijoin": {"relation": n.relation, "terms": [_term_out(t) for t in n.terms], "rest": _node_out(n.rest)}}


def _body(x: dict) -> ir.Body:
    return ir.Body(tuple(t if isinstance(t, str) else _type(t) for t in x["vars"]), tuple(x["loaded"]), _node(x["instructions"]))


def _body_out(b: ir.Body) -> dict:
    return {"vars": list(b.vars), "loaded": list(b.loaded), "instructions": _node_out(b.instructions)}


def loads(text: str) -> ir.Program:
    data = json.loads(text)
    program = ir.Program()
    for name, r in data["relations"].items():
        rules = [ir.Rule(tuple(map(_term, x["head"])), _body(x["body"])) for x in r["rules"]]
        program.relations[name] = ir.Relation(r["store"], _type(r["ty"]), r["kind"], r["io"], [tuple(map(_value, f)) for f in r["facts"]], rules, r["stratum"])
    for c in data["constraints"]:
        weight = None if c["weight"] == "Hard" else c["weight"]["Soft"]
        bound = c["kind"]["Cardinality"]
        program.constraints.append(ir.Constraint(tuple(c["head"]), _body(c["body"]), bound["kind"], bound["threshold"], weight))
    return program


def dumps(program: ir.Program) -> str:
    relations = {
        name: {"store": r.name, "stratum": r.stratum, "ty": _type_out(r.ty), "kind": r.kind, "io": r.io, "facts": [[_value_out(v) for v in f] for f in r.facts], "rules": [{"head": [_term_out(t) for t in x.head], "body": _body_out(x.body)} for x in r.rules]}
        for name, r in program.relations.items()
    }
    constraints = [{"weight": "Hard" if c.weight is None else {"Soft": c.weight}, "kind": {"Cardinality": {"kind": c.kind, "threshold": c.threshold}}, "head": list(c.head), "body": _body_out(c.body)} for c in program.constraints]
    return json.dumps({"relations": relations, "constraints": constraints}, indent=2)
