"""A fluent builder of query specifications."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ..errors import BadArgs
from ..operators import And, Cond, Op, Pred
from .spec import Agg, Col, Order, QuerySpec, Scalar, Star, compile_spec


class Builder:
    """query(df).where(...).select(...).to_df(); every step gives a new builder."""

    def __init__(self, df: DataFrame, spec: QuerySpec = QuerySpec()):
        self.df, self.spec = df, spec

    def _with(self, **changes) -> Builder:
        return Builder(self.df, replace(self.spec, **changes))

    def select(self, *items) -> Builder:
        return self._with(items=tuple(Star() if i == "*" else Col(i) if isinstance(i, str) else i for i in items))

    def where(self, *conds: Cond | tuple) -> Builder:
        """Conditions, or (column, op, value) tuples, all of which must hold; steps add up."""
        new = [Pred(c[0], Op(c[1]) if isinstance(c[1], str) else c[1], *c[2:]) if isinstance(c, tuple) else c for c in conds]
        old = [] if self.spec.where is None else [self.spec.where]
        return self._with(where=And.of(*old, *new)) if old or new else self

    def group_by(self, *names: str) -> Builder:
        return self._with(group=names)

    def having(self, cond: Cond) -> Builder:
        return self._with(having=cond)

    def distinct(self) -> Builder:
        return self._with(distinct=True)

    def order_by(self, *keys) -> Builder:
        """Names, ("name", "desc") pairs or Order keys."""
        return self._with(order=tuple(k if isinstance(k, Order) else Order(k[0], k[1].lower() == "desc") if isinstance(k, tuple) else Order(k) for k in keys))

    def limit(self, n: int | None) -> Builder:
        if n is not None and n < 0:
            raise BadArgs("a negative limit")
        return self._with(limit=n)

    def offset(self, n: int) -> Builder:
        if n < 0:
            raise BadArgs("a negative offset")
        return self._with(offset=n)

    def to_df(self) -> DataFrame:
        return compile_spec(self.df, self.spec)


def query(df: DataFrame) -> Builder:
    return Builder(df)


__all__ = ["Agg", "Builder", "Col", "Order", "Scalar", "Star", "query"]
