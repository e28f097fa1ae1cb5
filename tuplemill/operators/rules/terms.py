"""Terms, atoms and clauses, with unification, matching and subsumption.

A constant is typed: the int 1 isn't the float 1.0, and the symbol ``a`` isn't
the string ``"a"``.  An atom is a compound term whose head is its predicate.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    kind: str  # "int", "double", "symbol" or "string"
    value: int | float | str


@dataclass(frozen=True)
class Compound:
    head: Var | Const
    args: tuple


@dataclass(frozen=True)
class Literal:
    positive: bool
    atom: Compound | Const | Var


Clause = tuple[Literal, ...]
Bindings = dict[Var, object]


def resolve(term, bound: Bindings):
    while isinstance(term, Var) and term in bound:
        term = bound[term]
    return term


def substitute(term, bound: Bindings):
    term = resolve(term, bound)
    if isinstance(term, Compound):
        return Compound(substitute(term.head, bound), tuple(substitute(a, bound) for a in term.args))
    return term


def variables(term) -> set[Var]:
    if isinstance(term, Var):
        return {term}
    if isinstance(term, Compound):
        return set().union(variables(term.head), *map(variables, term.args))
    return set()


def occurs(var: Var, term, bound: Bindings) -> bool:
    term = resolve(term, bound)
    return term == var or isinstance(term, Compound) and (occurs(var, term.head, bound) or any(occurs(var, a, bound) for a in term.args))


def unify(a, b, bound: Bindings | None = None) -> Bindings | None:
    """Bindings that make two terms equal, with occurs check, or None."""
    out, todo = dict(bound or {}), [(a, b)]
    while todo:
        x, y = todo.pop()
        x, y = resolve(x, out), resolve(y, out)
        if x == y:
            continue
        if isinstance(x, Var) or isinstance(y, Var):
            var, term = (x, y) if isinstance(x, Var) else (y, x)
            if occurs(var, term, out):
                return None
            out[var] = term
        elif isinstance(x, Compound) and isinstance(y, Compound) and len(x.args) == len(y.args):
            todo += [(x.head, y.head), *zip(x.args, y.args, strict=True)]
        else:
            return None
    return out


def match(pattern, term, bound: Bindings | None = None) -> Bindings | None:
    """Bindings of the pattern's variables alone that make it the term, or None."""
    out, todo = dict(bound or {}), [(pattern, term)]
    while todo:
        p, t = todo.pop()
        if isinstance(p, Var):
            if out.setdefault(p, t) != t:
                return None
        elif isinstance(p, Compound) and isinstance(t, Compound) and len(p.args) == len(t.args):
            todo += [(p.head, t.head), *zip(p.args, t.args, strict=True)]
        elif p != t:
            return None
    return out


def subsumes(general: Clause, special: Clause) -> bool:
    """Whether each literal of one clause matches a literal of its own in the other, under one binding."""
    if len(general) > len(special):
        return False

    def place(k: int, used: frozenset, bound: Bindings) -> bool:
        if k == len(general):
            return True
        for j, lit in enumerate(special):
            if j not in used and lit.positive == general[k].positive:
                more = match(general[k].atom, lit.atom, bound)
                if more is not None and place(k + 1, used | {j}, more):
                    return True
        return False

    return place(0, frozenset(), {})


_fresh = count()


def renamed(clause: Clause) -> Clause:
    """The clause with variables that no other clause has."""
    bound = {v: Var(f"_{next(_fresh)}") for lit in clause for v in variables(lit.atom)}
    return tuple(Literal(lit.positive, substitute(lit.atom, bound)) for lit in clause)


def show(term) -> str:
    if isinstance(term, Var):
        return f"?{term.name}"
    if isinstance(term, Compound):
        return f"{show(term.head)}({','.join(map(show, term.args))})"
    if isinstance(term, Literal):
        return ("" if term.positive else "-") + show(term.atom)
    if isinstance(term, tuple):
        return " | ".join(map(show, term)) + "."
    if term.kind == "string":
        return '"' + term.value + '"'
    if term.kind == "symbol" and not term.value.replace("_", "a").isalnum() and term.value not in "+=":
        return "'" + term.value + "'"
    return str(term.value)
