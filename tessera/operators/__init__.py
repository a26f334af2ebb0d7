"""Relational operators: predicates on columns."""

from .predicates import And, Cond, Op, Or, Pred, condition, predicate, resolver, stored

__all__ = ["And", "Cond", "Op", "Or", "Pred", "condition", "predicate", "resolver", "stored"]
