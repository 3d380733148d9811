"""Rules over facts as join plans whose rows carry their proof.

A relation is a table (doc-independent) of columns a0, a1, ... and ``proof``, the ids of the stored facts behind each row.
A rule's body becomes one chain of equi-joins on shared variables; constants become filters, which Catalyst pushes
to the scans. Rules that use their own head are applied in rounds to the rows of the last round only.
Of several proofs of one row the shortest stays, of equally short ones the first in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lectern.operators.facts import GROUND_FUNCTORS
from lectern.session import cut_lineage


@dataclass(frozen=True)
class Var:
    """A variable of a rule or goal; any other term is a constant."""

    name: str


@dataclass(frozen=True)
class Atom:
    functor: str
    terms: tuple


@dataclass(frozen=True)
class Rule:
    """head :- body, with variables that must differ and bounds (variable, operator, number) on numeric ones."""

    head: Atom
    body: tuple[Atom, ...]
    differ: tuple[tuple[str, str], ...] = ()
    bounds: tuple[tuple[str, str, float], ...] = ()


def atom(functor: str, *terms) -> Atom:
    return Atom(functor, terms)


P, C, D, M, V = (Var(n) for n in ("Paper", "Concept", "Domain", "Mid", "Value"))

# The rules that facts of documents and an ontology are asked with.
BELONGS = tuple(
    rule
    for kind in ("is_a", "part_of")
    for rule in (Rule(atom("belongs_to", C, D), (atom(kind, C, D),)), Rule(atom("belongs_to", C, D), (atom(kind, C, M), atom("belongs_to", M, D))))
)
KEY_FACTS = {"method": "method", "dataset": "dataset", "accuracy": "accuracy", "task": "solves", "tool": "tool", "sample": "sample", "result": "result", "problem": "problem"}
RULES = (
    *BELONGS,
    *(Rule(atom("key_fact", P, kind, V), (atom(functor, P, V),)) for kind, functor in KEY_FACTS.items()),
    Rule(atom("key_fact", P, "domain", D), (atom("method", P, M), atom("belongs_to", M, D))),
    Rule(atom("explains_domain", P, M, D), (atom("method", P, M), atom("is_a", M, D))),
    Rule(atom("recommended_baseline", P, V), (atom("method", P, M), atom("related_to", M, V))),
    Rule(atom("same_dataset", P, Var("Other")), (atom("dataset", P, V), atom("dataset", Var("Other"), V)), differ=(("Paper", "Other"),)),
    Rule(atom("high_accuracy", P), (atom("accuracy", P, V),), bounds=(("Value", ">", 95.0),)),
    Rule(atom("moderate_accuracy", P), (atom("accuracy", P, V),), bounds=(("Value", ">", 80.0), ("Value", "<=", 95.0))),
    Rule(atom("low_accuracy", P), (atom("accuracy", P, V),), bounds=(("Value", "<=", 80.0),)),
)


def fact_id(functor: Column, args: Column) -> Column:
    return F.concat(functor, F.lit("("), F.array_join(args, ", ", "_"), F.lit(")"))


def shortest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per binding, with its shortest proof."""
    return rows.groupBy(*columns).agg(F.min(F.struct(F.size("proof").alias("n"), F.col("proof").alias("proof")))["proof"].alias("proof"))


@dataclass
class Base:
    """Stored facts(functor, args array<string>) and the rules over them."""

    facts: DataFrame
    rules: tuple[Rule, ...] = RULES
    closed: dict[str, DataFrame] = field(default_factory=dict)

    def relation(self, functor: str, size: int) -> DataFrame:
        """Facts of a functor with at least ``size`` arguments, and what its rules derive."""
        stored = self.facts.filter((F.col("functor") == functor) & (F.size("args") >= size))
        columns = [F.get("args", F.lit(k)).alias(f"a{k}") for k in range(size)]
        rows = stored.select(*columns, F.array(fact_id(F.col("functor"), F.col("args"))).alias("proof"))
        own = [r for r in self.rules if r.head.functor == functor and len(r.head.terms) == size]
        if not own:
            return rows
        if any(a.functor == functor for r in own for a in r.body):
            if functor not in self.closed:
                self.closed[functor] = self._fixpoint(functor, size, rows, own)
            return self.closed[functor]
        for rule in own:
            rows = rows.unionByName(self.apply(rule))
        return shortest(rows, [f"a{k}" for k in range(size)])

    def apply(self, rule: Rule, fresh: DataFrame | None = None) -> DataFrame:
        """Heads of a rule; ``fresh`` stands for the relation of atoms that repeat the head's functor."""
        joined = None
        for part in rule.body:
            source = fresh if fresh is not None and part.functor == rule.head.functor else self.relation(part.functor, len(part.terms))
            found = bind(source, part)
            if joined is None:
                joined = found
                continue
            shared = [c for c in found.columns if c in joined.columns and c != "proof"]
            found = found.withColumnRenamed("proof", "_proof")
            joined = joined.join(found, shared) if shared else joined.crossJoin(found)
            joined = joined.withColumn("proof", F.array_sort(F.array_union("proof", "_proof"))).drop("_proof")
        for a, b in rule.differ:
            joined = joined.filter(F.col(a) != F.col(b))
        for name, sign, limit in rule.bounds:
            value = F.col(name).try_cast("double")
            joined = joined.filter(value > limit if sign == ">" else value <= limit)
        heads = [F.col(t.name) if isinstance(t, Var) else F.lit(t) for t in rule.head.terms]
        return joined.select(*[h.alias(f"a{k}") for k, h in enumerate(heads)], "proof")

    def _fixpoint(self, functor: str, size: int, rows: DataFrame, own: list[Rule]) -> DataFrame:
        """Rounds over the last round's rows; each round is written once and none is written again."""
        columns = [f"a{k}" for k in range(size)]
        for rule in own:
            if not any(a.functor == functor for a in rule.body):
                rows = rows.unionByName(self.apply(rule))
        rounds = [cut_lineage(shortest(rows, columns))]
        while not rounds[-1].isEmpty():
            made = None
            for rule in own:
                if any(a.functor == functor for a in rule.body):
                    found = self.apply(rule, rounds[-1])
                    made = found if made is None else made.unionByName(found)
            for known in rounds:
                made = made.join(known.select(*columns), columns, "left_anti")
            rounds.append(cut_lineage(shortest(made, columns)))
        every = rounds[0]
        for part in rounds[1:-1]:
            every = every.unionByName(part)
        return every

    def solve(self, goal: Atom) -> DataFrame:
        """bindings map, evidence (ids of the facts used) and explanation of every answer of a goal."""
        found = bind(self.relation(goal.functor, len(goal.terms)), goal)
        names = [c for c in found.columns if c != "proof"]
        bindings = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]) if names else F.create_map().cast("map<string,string>")
        shown = F.array_join(F.array(*[F.concat(F.lit(f"{n} = "), F.coalesce(F.col(n), F.lit("_"))) for n in names]), ", ") if names else F.lit("goal satisfied")
        text = F.concat(shown, F.lit(" — derived from: "), F.array_join("proof", ", "))
        return found.select(bindings.alias("bindings"), F.col("proof").alias("evidence"), text.alias("explanation"))


def bind(rows: DataFrame, goal: Atom) -> DataFrame:
    """Rows that agree with a goal: constants filter, each variable is a column, repeated ones must be equal."""
    seen: dict[str, str] = {}
    for k, term in enumerate(goal.terms):
        if not isinstance(term, Var):
            rows = rows.filter(F.col(f"a{k}") == F.lit(term))
        elif term.name in seen:
            rows = rows.filter(F.col(f"a{k}") == F.col(seen[term.name]))
        else:
            seen[term.name] = f"a{k}"
    return rows.select(*[F.col(c).alias(n) for n, c in seen.items()], "proof")


def goal_confidence(answers: DataFrame, goal: Atom) -> DataFrame:
    """One row (goal, answers, confidence): 0 without answers, 0.4 if some answer leaves a variable open, 1 for stored facts, 0.7 for rules."""
    text = f"{goal.functor}({', '.join(t.name if isinstance(t, Var) else str(t) for t in goal.terms)})"
    wanted = len({t.name for t in goal.terms if isinstance(t, Var)})
    bound = F.size(F.filter(F.map_values("bindings"), lambda v: v.isNotNull()))
    whole = F.coalesce(F.min(bound >= wanted), F.lit(True))
    sure = 1.0 if goal.functor in GROUND_FUNCTORS else 0.7
    n = F.count("*")
    score = F.when(n == 0, 0.0).when(~whole, 0.4).otherwise(sure)
    return answers.agg(n.alias("answers"), score.alias("confidence")).select(F.lit(text).alias("goal"), "answers", "confidence")
