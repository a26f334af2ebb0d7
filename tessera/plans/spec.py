"""One query specification, which SQL text, the builder and predicate lists lower to, and its compiler to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadSchema
from ..functions import aggregate, scalar
from ..operators import Cond, condition, resolver


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Col:
    column: str
    alias: str | None = None

    @property
    def title(self) -> str:
        return self.alias or self.column


@dataclass(frozen=True)
class Scalar:
    function: str
    column: str
    alias: str | None = None

    @property
    def title(self) -> str:
        return self.alias or f"{self.function}({self.column})"


@dataclass(frozen=True)
class Agg:
    function: str
    column: str | None = None  # None: *
    distinct: bool = False
    alias: str | None = None

    @property
    def call(self) -> str:
        return f"{self.function}({'DISTINCT ' * self.distinct}{self.column or '*'})"

    @property
    def title(self) -> str:
        return self.alias or self.call


@dataclass(frozen=True)
class Order:
    column: object  # a name or an Agg
    descending: bool = False


@dataclass(frozen=True)
class QuerySpec:
    items: tuple = (Star(),)
    source: str | None = None
    where: Cond | None = None
    group: tuple[str, ...] = ()
    having: Cond | None = None
    distinct: bool = False
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0


def compile_spec(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """The DataFrame of a specification over its source."""
    resolve = resolver(df.schema)
    if spec.where is not None:
        df = df.where(condition(spec.where, resolve))
    grouped = bool(spec.group) or spec.having is not None or any(isinstance(i, Agg) for i in spec.items)
    return _grouped(df, spec, resolve) if grouped else _plain(df, spec, resolve)


def _plain(df: DataFrame, spec: QuerySpec, resolve) -> DataFrame:
    titles: list[str] = []
    out: list[Column] = []
    for item in spec.items:
        for one in [Col(n) for n in df.columns] if isinstance(item, Star) else [item]:
            col, kind = resolve(one.column)
            titles.append(one.title)
            out.append(scalar(one.function, col, kind) if isinstance(one, Scalar) else col)
    hidden: list[Column] = []

    def key(o: Order) -> str:
        if o.column in titles:
            return f"_o{titles.index(o.column)}"
        if spec.distinct:
            raise BadSchema(f"ORDER BY {o.column}: not selected by DISTINCT")
        hidden.append(resolve(o.column)[0])
        return f"_h{len(hidden) - 1}"

    keys = [(key(o), o.descending) for o in spec.order]
    df = df.select(*(c.alias(f"_o{i}") for i, c in enumerate(out)), *(c.alias(f"_h{i}") for i, c in enumerate(hidden)))
    return _finish(df.distinct() if spec.distinct else df, spec, keys, titles)


def _grouped(df: DataFrame, spec: QuerySpec, resolve) -> DataFrame:
    scalars = {i.alias: i for i in spec.items if isinstance(i, Scalar) and i.alias}
    aliases = {i.alias: i.column for i in spec.items if isinstance(i, Col) and i.alias}
    names = set(df.columns)
    keys: dict[object, Column] = {}  # a column's name or a Scalar's (function, column)
    kinds: dict[str, T.DataType] = {}
    for g in spec.group:
        if g in names:
            keys[g] = resolve(g)[0]
        elif g in scalars:
            s = scalars[g]
            keys[(s.function, s.column)] = scalar(s.function, *resolve(s.column))
        elif g in aliases:
            keys[aliases[g]] = resolve(aliases[g])[0]
        else:
            raise BadSchema(f"GROUP BY {g}: unknown column")
    places = {k: f"_k{i}" for i, k in enumerate(keys)}
    calls: dict[str, str] = {}  # an aggregate's text and its column
    made: list[Column] = []

    def call(a: Agg) -> str:
        if a.call not in calls:
            calls[a.call] = f"_a{len(calls)}"
            made.append(aggregate(a.function, None if a.column is None else resolve(a.column)[0], a.distinct).alias(calls[a.call]))
        return calls[a.call]

    titles, out = [], []
    for item in spec.items:
        titles.append("*" if isinstance(item, Star) else item.title)
        if isinstance(item, Agg):
            out.append(F.col(call(item)))
        elif isinstance(item, Col) and item.column in places:
            out.append(F.col(places[item.column]))
        elif isinstance(item, Scalar) and (item.function, item.column) in places:
            out.append(F.col(places[(item.function, item.column)]))
        elif isinstance(item, Scalar) and item.column in places:
            out.append(scalar(item.function, F.col(places[item.column]), resolve(item.column)[1]))
        else:
            raise BadSchema(f"{titles[-1]}: neither grouped nor aggregated")
    aggs = [i for i in spec.items if isinstance(i, Agg)]

    def place(name: object) -> str | Column:
        """A name in HAVING or ORDER BY: an aggregate call, a title, a key, or the one aggregate of a column."""
        if isinstance(name, Agg):
            return call(name)
        if name in titles:
            return out[titles.index(name)]
        if name in places:
            return places[name]
        of = {i.call: i for i in aggs if i.column == name}
        if len(of) == 1:
            return call(next(iter(of.values())))
        raise BadSchema(f"{name}: " + ("more than one aggregate" if of else "neither grouped nor aggregated"))

    def expression(name: object) -> Column:
        p = place(name)
        return F.col(p) if isinstance(p, str) else p

    sorts = [(expression(o.column), o.descending) for o in spec.order]
    wanted: list[object] = []

    def collect(c: Cond) -> None:
        for p in getattr(c, "parts", ()) or (c,):
            collect(p) if hasattr(p, "parts") else wanted.append(p.column)

    if spec.having is not None:
        collect(spec.having)
        for w in wanted:
            expression(w)
    by = [c.alias(places[k]) for k, c in keys.items()]
    df = df.groupBy(*by).agg(*made) if made else df.select(*by).distinct()
    if spec.having is not None:
        kind = lambda name: (expression(name), df.select(expression(name)).schema[0].dataType)
        df = df.where(condition(spec.having, kind))
    df = df.select(*(c.alias(f"_o{i}") for i, c in enumerate(out)), *(c.alias(f"_h{i}") for i, (c, _) in enumerate(sorts)))
    if spec.distinct:
        if any(not isinstance(o.column, str) or o.column not in titles for o in spec.order):
            raise BadSchema("ORDER BY: not selected by DISTINCT")
        df = df.distinct()
    return _finish(df, spec, [(f"_h{i}", d) for i, (_, d) in enumerate(sorts)], titles)


def _finish(df: DataFrame, spec: QuerySpec, keys: list[tuple[str, bool]], titles: list[str]) -> DataFrame:
    """Sort (nulls smallest), offset, limit, and the titles."""
    if keys:
        df = df.orderBy(*(F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_first() for k, d in keys))
    if spec.offset:
        df = df.offset(spec.offset)
    if spec.limit is not None:
        df = df.limit(spec.limit)
    return df.select(*(f"_o{i}" for i in range(len(titles)))).toDF(*titles)
