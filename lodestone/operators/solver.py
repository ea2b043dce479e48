"""Partial weighted MaxSAT over clauses and weighted bounds, by conflict-driven search.

Literals are nonzero integers. A bound says that the weights of its true literals sum to at most a number, if its guard (a
literal, or None) doesn't excuse it. Search learns clauses, and each better model tightens the bound on the cost.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass


@dataclass
class _Bound:
    weights: dict[int, int]
    most: int
    guard: int | None
    held: int = 0


class Solver:
    def __init__(self):
        self.n = 0
        self.phase: list[bool] = [False]
        self.value: list[int] = [0]
        self.level: list[int] = [0]
        self.reason: list[list[int] | None] = [None]
        self.activity: list[float] = [0.0]
        self.watch: dict[int, list[list[int]]] = {}
        self.in_bounds: dict[int, list[_Bound]] = {}
        self.guarded: dict[int, list[_Bound]] = {}
        self.trail: list[int] = []
        self.limits: list[int] = []
        self.at = 0
        self.bounds: list[_Bound] = []
        self.ok = True
        self.step = 1.0

    def var(self, phase: bool = False) -> int:
        self.n += 1
        for column, v in ((self.phase, phase), (self.value, 0), (self.level, 0), (self.reason, None), (self.activity, 0.0)):
            column.append(v)
        return self.n

    def truth(self, lit: int) -> int:
        return self.value[lit] if lit > 0 else -self.value[-lit]

    def clause(self, lits: list[int]) -> None:
        """At level 0: at least one of lits."""
        lits = list(dict.fromkeys(lits))
        if any(-x in lits for x in lits) or any(self.truth(x) > 0 for x in lits):
            return
        lits = [x for x in lits if self.truth(x) == 0]
        if not lits:
            self.ok = False
        elif len(lits) == 1:
            self._set(lits[0], None)
        else:
            self._attach(lits)

    def _attach(self, lits: list[int]) -> None:
        for x in lits[:2]:
            self.watch.setdefault(-x, []).append(lits)

    def at_most(self, weights: dict[int, int], most: int, guard: int | None = None) -> _Bound:
        b = _Bound(weights, most, guard, sum(w for x, w in weights.items() if self.truth(x) > 0))
        self.bounds.append(b)
        for x in weights:
            self.in_bounds.setdefault(x, []).append(b)
        if guard is not None:
            self.guarded.setdefault(-guard, []).append(b)
        if self._enforce(b) is not None:
            self.ok = False
        return b

    def _set(self, lit: int, reason: list[int] | None) -> None:
        v = abs(lit)
        self.value[v] = 1 if lit > 0 else -1
        self.level[v] = len(self.limits)
        self.reason[v] = reason
        self.trail.append(lit)
        for b in self.in_bounds.get(lit, ()):
            b.held += b.weights[lit]

    def _enforce(self, b: _Bound) -> list[int] | None:
        """Sets what a bound forces; a clause that is false, if it can't be met."""
        excused = 0 if b.guard is None else self.truth(b.guard)
        if excused > 0:
            return None
        why = None
        if b.held > b.most:
            why = [-x for x in b.weights if self.truth(x) > 0]
            if b.guard is None:
                return why
            if excused < 0:
                return [b.guard, *why]
            self._set(b.guard, [b.guard, *why])
            return None
        if b.guard is not None and excused == 0:
            return None
        for x, w in b.weights.items():
            if b.held + w > b.most and self.truth(x) == 0:
                if why is None:
                    why = [-y for y in b.weights if self.truth(y) > 0] + ([b.guard] if b.guard is not None else [])
                self._set(-x, [-x, *why])
        return None

    def _propagate(self) -> list[int] | None:
        while self.at < len(self.trail):
            lit = self.trail[self.at]
            self.at += 1
            watching, kept = self.watch.get(lit, []), []
            for i, c in enumerate(watching):
                if c[0] == -lit:
                    c[0], c[1] = c[1], c[0]
                if self.truth(c[0]) > 0:
                    kept.append(c)
                    continue
                for k in range(2, len(c)):
                    if self.truth(c[k]) >= 0:
                        c[1], c[k] = c[k], c[1]
                        self.watch.setdefault(-c[1], []).append(c)
                        break
                else:
                    kept.append(c)
                    if self.truth(c[0]) < 0:
                        self.watch[lit] = kept + watching[i + 1 :]
                        return c
                    self._set(c[0], c)
            self.watch[lit] = kept
            for b in (*self.in_bounds.get(lit, ()), *self.guarded.get(lit, ())):
                if (conflict := self._enforce(b)) is not None:
                    return conflict
        return None

    def _analyse(self, conflict: list[int]) -> tuple[list[int], int]:
        """The first clause on the way to the conflict with one literal of this level, and the level to go back to."""
        learnt, seen, open_, at, lit = [], set(), 0, len(self.trail) - 1, None
        now = len(self.limits)
        while True:
            for x in conflict:
                v = abs(x)
                if x != lit and v not in seen and self.level[v] > 0:
                    seen.add(v)
                    self.activity[v] += self.step
                    if self.level[v] == now:
                        open_ += 1
                    else:
                        learnt.append(x)
            while abs(self.trail[at]) not in seen:
                at -= 1
            lit = self.trail[at]
            at -= 1
            open_ -= 1
            if open_ == 0:
                break
            conflict = self.reason[abs(lit)]
        self.step *= 1.05
        if self.step > 1e100:
            self.activity = [a * 1e-100 for a in self.activity]
            self.step *= 1e-100
        learnt.sort(key=lambda x: -self.level[abs(x)])
        return [-lit, *learnt], self.level[abs(learnt[0])] if learnt else 0

    def _back(self, level: int) -> None:
        if len(self.limits) <= level:
            return
        for lit in self.trail[self.limits[level] :]:
            self.phase[abs(lit)] = lit > 0
            self.value[abs(lit)] = 0
            for b in self.in_bounds.get(lit, ()):
                b.held -= b.weights[lit]
        del self.trail[self.limits[level] :]
        del self.limits[level:]
        self.at = len(self.trail)

    def _fault(self) -> list[int] | None:
        """A conflict among what level 0 says, after a bound became tighter."""
        return next((c for c in map(self._enforce, self.bounds) if c is not None), None)

    def solve(self, conflicts: int = 1_000_000) -> bool | None:
        """Whether there is a model; None if so many conflicts didn't tell. The model is left in value."""
        self._back(0)
        if not self.ok or self._fault() is not None:
            return False
        while True:
            if (conflict := self._propagate()) is not None:
                if not self.limits:
                    return False
                conflicts -= 1
                if conflicts < 0:
                    return None
                # a bound may find a conflict that is all of earlier levels
                top = max((self.level[abs(x)] for x in conflict), default=0)
                if top == 0:
                    return False
                self._back(top)
                learnt, level = self._analyse(conflict)
                self._back(level)
                if len(learnt) > 1:
                    self._attach(learnt)
                self._set(learnt[0], learnt)
                continue
            free = [v for v in range(1, self.n + 1) if self.value[v] == 0]
            if not free:
                return True
            v = max(free, key=lambda x: (self.activity[x], -x))
            self.limits.append(len(self.trail))
            self._set(v if self.phase[v] else -v, None)


@dataclass
class Problem:
    """A component: facts (name, kind, free, derivations) and groups (kind, threshold, weight, terms), all by literal strings."""

    facts: list[tuple[str, str, bool, list[list[str]]]]
    groups: list[tuple[str, int, int | None, list[list[str]]]]


@dataclass
class Result:
    status: str  # SAT, UNSAT or UNKNOWN
    cost: int
    true: list[str]


def solve(problem: Problem, conflicts: int | None = None) -> Result:
    """The best model; with a limit on conflicts the best one found, FEASIBLE, or UNKNOWN where none was. A model at the least cost that the hard groups allow is tried for first, since none is better."""
    conflicts = conflicts or 1 << 62
    if any(w is not None for _, _, w, _ in problem.groups):
        found = _solve(problem, min(conflicts, 20_000), True)
        if found is not None:
            return found
    return _solve(problem, conflicts, False)


def _solve(problem: Problem, conflicts: int, at_least_cost: bool) -> Result | None:
    s = Solver()
    facts = sorted(problem.facts)
    number = {}
    for fact, kind, *_ in facts:
        number[fact] = s.var(kind == "Decision")
    gates: dict[tuple, int] = {}

    def literal(text: str) -> int:
        v = number[text[2:]]
        return v if text[0] == "F" else -v

    def gate(cond: list[str]) -> int:
        """A literal for a conjunction. Conditions that differ only in order are different gates with the same meaning."""
        if len(cond) == 1:
            return literal(cond[0])
        key = tuple(cond)
        if key not in gates:
            gates[key] = g = s.var()
            lits = [literal(x) for x in cond]
            for x in lits:
                s.clause([-g, x])
            s.clause([g, *[-x for x in lits]])
        return gates[key]

    for fact, kind, free, ders in facts:
        f = number[fact]
        if free:
            if kind == "Conditional":
                s.clause([f])
            continue
        ways = [gate(d) for d in sorted(ders)]
        s.clause([-f, *ways])
        if kind == "Conditional":
            for w in ways:
                s.clause([-w, f])
    costs: dict[int, int] = {}
    exact_one: list[tuple[int, list[int], int]] = []
    for kind, k, weight, terms in sorted(problem.groups, key=repr):
        lits = [gate(t) for t in sorted(terms)]
        guard = None
        if weight is not None:
            guard = s.var()
            costs[guard] = weight
        count: dict[int, int] = {}
        for x in lits:
            count[x] = count.get(x, 0) + 1
        if kind in ("Only", "AtMost"):
            s.at_most(count, k, guard)
            if guard is None:
                exact_one.append((k, lits, 0))
        if kind in ("Only", "AtLeast"):
            if k == 1 and guard is None:
                s.clause(lits)
            else:
                s.at_most({-x: c for x, c in count.items()}, len(lits) - k, guard)
            if guard is not None and len(lits) == 1 and k == 1:
                exact_one.append((-1, lits, guard))
    best: list[int] | None = None
    cost = sum(costs.values()) + 1
    least, limited = _least(exact_one, costs)
    cap = s.at_most(dict(costs), least if at_least_cost else cost) if costs else None
    if at_least_cost:
        for k, lits in limited:  # no wish beyond what the group's limit costs may be missed
            s.at_most({-x: 1 for x in lits}, len(lits) - k)
        if not s.solve(conflicts):
            return None
        return Result("SAT", least, [f for f, v in number.items() if s.value[v] > 0])
    while True:
        found = s.solve(conflicts)
        if not found:
            break
        best = list(s.value)
        cost = sum(w for g, w in costs.items() if best[g] > 0)
        if cost <= least:
            found = False
            break
        s._back(0)
        cap.most = cost - 1
    if best is None:
        return Result("UNSAT" if found is False else "UNKNOWN", 0, [])
    return Result("SAT" if found is False else "FEASIBLE", cost, [f for f, v in number.items() if best[v] > 0])


def _least(groups: list, costs: dict[int, int]) -> tuple[int, list[tuple[int, list[int]]]]:
    """A cost that no model goes below: of literals that disjoint hard groups limit, those beyond the limit miss their soft wish.

    Also the groups (limit, literals) that it comes from.
    """
    wish = {lits[0]: guard for k, lits, guard in groups if k < 0}
    used: set[int] = set()
    out, limited = 0, []
    # the group with the most literals left first; counts only fall, so an old count is checked when it comes up
    queue = [(-len(lits), i, k, lits) for i, (k, lits, _) in enumerate(groups) if k >= 0]
    heapq.heapify(queue)
    while queue:
        size, i, k, lits = heapq.heappop(queue)
        own = [x for x in dict.fromkeys(lits) if x in wish and x not in used]
        if len(own) < -size:
            heapq.heappush(queue, (-len(own), i, k, lits))
        elif len(own) > k:
            used.update(own)
            out += sum(sorted(costs[wish[x]] for x in own)[: len(own) - k])
            if len({costs[wish[x]] for x in own}) == 1:
                limited.append((k, own))
    return out, limited
