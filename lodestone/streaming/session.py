"""Sessions: a program with changing inputs, transactions, epochs and change feeds."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decide import Outcome, decide
from ..operators.fixpoint import frame_schema, normalised
from ..operators.storage import settle
from ..plans import ir
from ..plans.validate import validate
from ..sources import json_io, text


class SessionError(RuntimeError):
    """kind is one of NoProgramLoaded, NoSuchRelation, TypeMismatch, InvalidProgram, Conflict, UnknownTransaction,
    ExistingTransaction, UnknownSubscription, ExistingSubscription."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind = kind


@dataclass
class _State:
    program: ir.Program | None = None
    inputs: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class _Transaction:
    epoch: int
    state: _State
    touched: set[str] = field(default_factory=set)


def _flatten(value: Any) -> list:
    return [x for v in value for x in _flatten(v)] if isinstance(value, (tuple, list)) else [value]


def _type_of(v: Any) -> str:
    return {bool: "Boolean", int: "Integer", float: "Real", str: "String"}.get(type(v), type(v).__name__)


class Input:
    """A handle on an input relation."""

    def __init__(self, session: Session, name: str):
        self.session, self.name, self.id = session, name, name

    def insert(self, *values: Any) -> int:
        return self.session.update_input(self.name, [(True, v) for v in values])

    def remove(self, *values: Any) -> int:
        return self.session.update_input(self.name, [(False, v) for v in values])

    def get_all(self) -> list:
        return self.session.values(self.name)


class Output:
    def __init__(self, session: Session, name: str):
        self.session, self.name, self.id = session, name, name

    def get_all(self) -> list:
        return self.session.values(self.name)


class Session:
    def __init__(self, spark: SparkSession):
        self.spark, self.epoch = spark, 0
        self._state = _State()
        self._changed: dict[str, int] = {}  # the epoch at which an input or the program ("") last changed
        self._open: dict[str, _Transaction] = {}
        self._outcome: Outcome | None = None
        self._watched: dict[str, tuple[str, DataFrame]] = {}

    # Programs

    def get_program(self) -> ir.Program:
        if self._state.program is None:
            raise SessionError("NoProgramLoaded")
        return self._state.program

    def set_program(self, program: ir.Program | str, tx: str | None = None) -> int | None:
        """Checks and swaps the program; all inputs are emptied."""
        try:
            checked = validate(json_io.loads(program) if isinstance(program, str) else program)
        except ValueError as e:
            raise SessionError("InvalidProgram", str(e)) from e
        inputs = {n: self.spark.createDataFrame([], frame_schema(r.columns)) for n, r in checked.relations.items() if r.io == "Input"}

        def change(state: _State) -> set[str]:
            state.program, state.inputs = checked, inputs
            return {"", *inputs}

        return self._apply(change, tx)

    def list_relations(self) -> DataFrame:
        """(name, id, ty, is_input): inputs first, then outputs."""
        found = self.get_program().relations.values()
        rows = [(r.name, r.name, json.dumps(r.ty), r.io == "Input") for io in ("Input", "Output") for r in found if r.io == io]
        return self.spark.createDataFrame(rows, "name string, id string, ty string, is_input boolean")

    def get_inputs(self) -> list[Input]:
        return [Input(self, n) for n, r in self.get_program().relations.items() if r.io == "Input"]

    def get_outputs(self) -> list[Output]:
        return [Output(self, n) for n, r in self.get_program().relations.items() if r.io == "Output"]

    def get_input(self, name: str) -> Input:
        self._relation(name, "Input")
        return Input(self, name)

    def get_output(self, name: str) -> Output:
        self._relation(name, "Output")
        return Output(self, name)

    def _relation(self, name: str, *io: str, state: _State | None = None) -> ir.Relation:
        program = (state or self._state).program
        if program is None:
            raise SessionError("NoProgramLoaded")
        relation = program.relations.get(name)
        if relation is None or relation.io not in io:
            raise SessionError("NoSuchRelation", name)
        return relation

    # Inputs

    def _rows(self, relation: ir.Relation, values: list) -> DataFrame:
        rows = []
        for v in values:
            row = _flatten(v)
            got = [_type_of(x) for x in row]
            fits = len(row) == len(relation.columns) and all(g == t or (g, t) in (("String", "Symbol"), ("Integer", "Real")) for g, t in zip(got, relation.columns))
            if not fits:
                raise SessionError("TypeMismatch", f"expected {relation.columns}, got {got}")
            rows.append(tuple(float(x) if t == "Real" else x for x, t in zip(row, relation.columns)))
        return self.spark.createDataFrame(rows, frame_schema(relation.columns))

    def update_input(self, name: str, updates: list | DataFrame, state: bool = True, tx: str | None = None) -> int | None:
        """Inserts or removes rows: pairs (state, value), or a table whose rows all have one state. Repeats change nothing."""
        relation = self._relation(name, "Input", state=self._open[tx].state if tx in self._open else None)
        if isinstance(updates, DataFrame):
            steps = [(state, normalised(updates, relation))]
        else:
            steps = []
            for kind, value in updates:  # runs of one state, in order
                if steps and steps[-1][0] == kind:
                    steps[-1][1].append(value)
                else:
                    steps.append((kind, [value]))
            steps = [(kind, self._rows(relation, values)) for kind, values in steps]

        def change(held: _State) -> set[str]:
            df = held.inputs[name]
            for kind, rows in steps:
                df = df.unionByName(rows).distinct() if kind else df.join(rows.distinct(), df.columns, "left_anti")
            held.inputs[name] = settle(df, name)
            return {name}

        return self._apply(change, tx)

    def clear_input(self, name: str, tx: str | None = None) -> int | None:
        relation = self._relation(name, "Input")

        def change(held: _State) -> set[str]:
            held.inputs[name] = self.spark.createDataFrame([], frame_schema(relation.columns))
            return {name}

        return self._apply(change, tx)

    def check_tuples(self, name: str, values: list) -> list[bool]:
        """Which values an input holds, in the order asked."""
        relation = self._relation(name, "Input")
        asked = self._rows(relation, values)
        held = {tuple(r) for r in self._state.inputs[name].join(asked.distinct(), asked.columns, "left_semi").collect()}
        return [tuple(float(x) if t == "Real" else x for x, t in zip(_flatten(v), relation.columns)) in held for v in values]

    # Transactions

    def begin(self, tx: str | None = None) -> str:
        tx = tx or uuid.uuid4().hex
        if tx in self._open:
            raise SessionError("ExistingTransaction", tx)
        self._open[tx] = _Transaction(self.epoch, _State(self._state.program, dict(self._state.inputs)))
        return tx

    @contextmanager
    def inside(self, tx: str | None):
        """Reads of inputs and of the program see what a transaction has made of them."""
        if tx is None:
            yield
            return
        if tx not in self._open:
            raise SessionError("UnknownTransaction", tx)
        held, self._state = self._state, self._open[tx].state
        try:
            yield
        finally:
            self._state = held

    def _apply(self, change: Any, tx: str | None) -> int | None:
        if tx is not None:
            if tx not in self._open:
                raise SessionError("UnknownTransaction", tx)
            self._open[tx].touched |= change(self._open[tx].state)
            return None
        state = _State(self._state.program, dict(self._state.inputs))
        return self._publish(state, change(state))

    def commit(self, tx: str) -> int:
        """Publishes a transaction's changes as one epoch, unless what it touched, or the program, has changed since it began."""
        if tx not in self._open:
            raise SessionError("UnknownTransaction", tx)
        found = self._open.pop(tx)
        if any(self._changed.get(n, 0) > found.epoch for n in {*found.touched, ""}):
            raise SessionError("Conflict", tx)
        state = _State(self._state.program, dict(self._state.inputs))
        state.program = found.state.program
        if "" in found.touched:
            state.inputs = found.state.inputs
        for n in found.touched - {""}:
            state.inputs[n] = found.state.inputs[n]
        return self._publish(state, found.touched)

    def rollback(self, tx: str) -> None:
        if self._open.pop(tx, None) is None:
            raise SessionError("UnknownTransaction", tx)

    def _publish(self, state: _State, touched: set[str]) -> int:
        self.epoch += 1
        self._state, self._outcome = state, None
        self._changed |= dict.fromkeys(touched, self.epoch)
        return self.epoch

    # Outputs

    def outcome(self) -> Outcome:
        if self._outcome is None:
            self._outcome = decide(self.spark, self.get_program(), self._state.inputs)
        return self._outcome

    def get_tuples(self, name: str) -> DataFrame:
        """An input's or output's rows, sorted."""
        relation = self._relation(name, "Input", "Output")
        df = self._state.inputs[name] if relation.io == "Input" else self.outcome().outputs[name]
        return df.sort(*df.columns)

    def values(self, name: str) -> list:
        """get_tuples() as Python values, nested as the relation's type is."""
        return [self.nested(name, list(r)) for r in self.get_tuples(name).collect()]

    def nested(self, name: str, row: list) -> Any:
        """A row's columns, nested as the relation's type is."""

        def nest(ty: ir.Type, row: list) -> Any:
            return row.pop(0) if isinstance(ty, str) else tuple(nest(t, row) for t in ty)

        return nest(self._relation(name, "Input", "Output").ty, row)

    def lines(self, name: str) -> DataFrame:
        return text.lines(self.get_tuples(name), self._relation(name, "Input", "Output"))

    # Change feeds

    def watch(self, name: str, key: str | None = None) -> str:
        """Starts a feed; its first changes() are all rows there are now."""
        self._relation(name, "Input", "Output")
        key = key or uuid.uuid4().hex
        if key in self._watched:
            raise SessionError("ExistingSubscription", key)
        df = self.get_tuples(name)
        self._watched[key] = (name, df.limit(0))
        return key

    def changes(self, key: str) -> DataFrame:
        """(state, c0, c1, ...): rows that came (true) and went (false) since the last call."""
        if key not in self._watched:
            raise SessionError("UnknownSubscription", key)
        name, old = self._watched[key]
        new = settle(self.get_tuples(name), name)
        self._watched[key] = (name, new)
        came = new.exceptAll(old).withColumn("state", F.lit(True))
        return came.unionByName(old.exceptAll(new).withColumn("state", F.lit(False))).select("state", *new.columns)

    def unwatch(self, key: str) -> None:
        if self._watched.pop(key, None) is None:
            raise SessionError("UnknownSubscription", key)

    # Storage and streams

    def save(self, path: str) -> None:
        """The program and all inputs under a folder that Spark can write to."""
        self.spark.createDataFrame([(json_io.dumps(self.get_program()),)], "program string").coalesce(1).write.mode("overwrite").parquet(f"{path}/program")
        for name, df in self._state.inputs.items():
            df.write.mode("overwrite").parquet(f"{path}/inputs/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Session:
        out = cls(spark)
        out.set_program(spark.read.parquet(f"{path}/program").first()[0])
        for name in out._state.inputs:
            out.update_input(name, spark.read.parquet(f"{path}/inputs/{name}"))
        return out

    def batch_writer(self, name: str):
        """For writeStream.foreachBatch: rows (state boolean, then the input's columns) become one epoch for each batch."""

        def write(batch: DataFrame, _: int) -> None:
            columns = [c for c in batch.columns if c != "state"]
            tx = self.begin()
            self.update_input(name, batch.where("state").select(*columns), True, tx)
            self.update_input(name, batch.where("not state").select(*columns), False, tx)
            self.commit(tx)

        return write
