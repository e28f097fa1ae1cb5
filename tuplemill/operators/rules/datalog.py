"""Function-free Horn rules as a semi-naive DataFrame fixpoint.

A predicate is a table with columns c0, c1, ...; a rule body is one multi-way
equi-join on shared variables; a round joins only what the last round added.
New facts are told from known ones by an anti-join, and each round is
checkpointed.  ``=`` in a body is a filter or an assignment, ``+`` an
arithmetic projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable
from .terms import Clause, Compound, Const, Literal, Var

Key = tuple[str, int]


def is_horn(clause: Clause) -> bool:
    """At most one positive literal, and no function terms but ``+``."""
    flat = lambda t: not isinstance(t, Compound) or t.head == Const("symbol", "+") and all(map(flat, t.args))
    return sum(lit.positive for lit in clause) <= 1 and all(isinstance(lit.atom, Compound) and isinstance(lit.atom.head, Const) and all(map(flat, lit.atom.args)) for lit in clause)


def key_of(atom: Compound) -> Key:
    return (atom.head.value, len(atom.args))


class RuleSet:
    """Rules over tables of facts.

    ``budget`` bounds the rounds; ``closure`` raises if it runs out.
    """

    def __init__(self, clauses: list[Clause], budget: int = 1000) -> None:
        bad = [c for c in clauses if not is_horn(c)]
        if bad:
            raise ValueError("only function-free Horn clauses run as a fixpoint; use the prover for others")
        self.budget = budget
        self.rules = [(next(lit.atom for lit in c if lit.positive), [lit.atom for lit in c if not lit.positive]) for c in clauses if len(c) > 1 and any(lit.positive for lit in c)]
        self.facts = [c[0].atom for c in clauses if len(c) == 1 and c[0].positive]
        self.goals = [[lit.atom for lit in c] for c in clauses if not any(lit.positive for lit in c)]

    # -- one rule

    @staticmethod
    def _expression(term, held: dict[Var, Column]) -> Column:
        if isinstance(term, Var):
            return held[term]
        if isinstance(term, Const):
            return F.lit(term.value)
        return RuleSet._expression(term.args[0], held) + RuleSet._expression(term.args[1], held)

    def body(self, atoms: list[Compound], tables: list[DataFrame]) -> tuple[DataFrame, dict[Var, Column]]:
        """The join of the tables of a body's atoms, and the column of each variable."""
        relations = [(a, t) for a, t in zip(atoms, tables, strict=True) if t is not None]
        joined, held = None, {}
        for n, (atom, table) in enumerate(relations):
            table = table.toDF(*[f"_{n}_{k}" for k in range(len(atom.args))])
            on, new = [], {}
            for k, term in enumerate(atom.args):
                column = F.col(f"_{n}_{k}")
                if isinstance(term, Const):
                    table = table.where(column == F.lit(term.value))
                elif term in new:
                    table = table.where(new[term] == column)
                elif term in held:
                    on.append(held[term] == column)
                    new[term] = column
                else:
                    new[term] = column
            joined = table if joined is None else joined.join(table, reduce(lambda a, b: a & b, on)) if on else joined.crossJoin(table)
            held = new | held
        for atom in [a for a, t in zip(atoms, tables, strict=True) if t is None]:  # computed =
            left, right = atom.args
            if isinstance(left, Var) and left not in held:
                held[left] = self._expression(right, held)
            elif isinstance(right, Var) and right not in held:
                held[right] = self._expression(left, held)
            else:
                joined = joined.where(self._expression(left, held) == self._expression(right, held))
        return joined, held

    def derive(self, head: Compound, atoms: list[Compound], tables: list[DataFrame]) -> DataFrame:
        joined, held = self.body(atoms, tables)
        return joined.select(*[self._expression(t, held).alias(f"c{k}") for k, t in enumerate(head.args)]).distinct()

    # -- the fixpoint

    def closure(self, tables: dict[Key, DataFrame], spark: SparkSession | None = None) -> dict[Key, DataFrame]:
        """All facts that follow from ``tables`` and the rule set's own facts."""
        known = {k: durable(t.toDF(*[f"c{n}" for n in range(k[1])]).distinct()) for k, t in tables.items()}
        for atom in self.facts:
            spark = spark or SparkSession.getActiveSession()
            row = spark.createDataFrame([tuple(a.value for a in atom.args)], [f"c{n}" for n in range(len(atom.args))])
            known[key_of(atom)] = known[key_of(atom)].union(row).distinct() if key_of(atom) in known else row
        derived = {key_of(h) for h, _ in self.rules}
        delta = dict(known)
        for _ in range(self.budget):
            fresh: dict[Key, DataFrame] = {}
            for head, atoms in self.rules:
                relational = [n for n, a in enumerate(atoms) if a.head.value != "="]
                for n in relational:
                    if key_of(atoms[n]) not in delta or any(key_of(atoms[m]) not in known for m in relational):
                        continue
                    found = self.derive(head, atoms, [None if m not in relational else delta[key_of(a)] if m == n else known[key_of(a)] for m, a in enumerate(atoms)])
                    k = key_of(head)
                    fresh[k] = fresh[k].union(found) if k in fresh else found
            delta = {}
            for k, found in fresh.items():
                found = found.distinct()
                if k in known:
                    found = found.join(known[k], [f"c{n}" for n in range(k[1])], "left_anti")
                found = durable(found)
                if not found.isEmpty():
                    delta[k] = found
            if not delta:
                return known
            for k, found in delta.items():
                known[k] = known[k].union(found) if k in known else found  # of checkpoints: a round adds its own facts alone
            if not any(key_of(a) in derived for _, atoms in self.rules for a in atoms):
                return known
        raise RuntimeError("the fixpoint needs more rounds than its budget")

    def refuted(self, tables: dict[Key, DataFrame]) -> bool:
        """Whether some goal clause's body holds, which contradicts it."""
        known = self.closure(tables)
        for atoms in self.goals:
            if all(key_of(a) in known or a.head.value == "=" for a in atoms):
                joined, _ = self.body(atoms, [None if a.head.value == "=" else known[key_of(a)] for a in atoms])
                if not joined.isEmpty():
                    return True
        return False


def query_literal(name: str, *args) -> Literal:
    """A negative literal, for goals built in Python."""
    return Literal(False, Compound(Const("symbol", name), tuple(args)))
