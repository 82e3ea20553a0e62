"""A declarative query layer: filters, order, pages, distinct rows, nested relations; compiled to one DataFrame plan.

    Query("transaction").where({"fee_satoshis": {"_gt": 0}}).order_by({"fee_satoshis": "desc"}).limit(5)

A filter is a tree of _and, _or, _not, columns with comparisons, and relations (rows that have a related row that
fits). Ascending order puts nulls last, descending first, unless said otherwise. Relations are joined set-wise: a
filter by a semi join, a nested list by one grouped join with its own filter, order and limits, never row by row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ROW_CAPS


def similar_to_regex(pattern: str) -> str:
    """SQL's SIMILAR TO as an anchored regular expression."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif in_class:
            in_class = c != "]"
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
        elif c in "%_":
            out.append(".*" if c == "%" else ".")
        else:
            out.append(c if c in "|*+?{}()" or c.isalnum() else re.escape(c))
        i += 1
    return f"(?s)^(?:{''.join(out)})$"


#: Comparisons by name. Each gives null for a null column, so both a test and its opposite drop the row.
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "_eq": lambda c, v: c == v,
    "_neq": lambda c, v: c != v,
    "_gt": lambda c, v: c > v,
    "_gte": lambda c, v: c >= v,
    "_lt": lambda c, v: c < v,
    "_lte": lambda c, v: c <= v,
    "_in": lambda c, v: c.isin(v) if v else F.lit(False),
    "_nin": lambda c, v: ~c.isin(v) if v else F.lit(True),
    "_is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
    "_like": lambda c, v: c.like(v),
    "_nlike": lambda c, v: ~c.like(v),
    "_ilike": lambda c, v: c.ilike(v),
    "_nilike": lambda c, v: ~c.ilike(v),
    "_regex": lambda c, v: c.rlike(v),
    "_nregex": lambda c, v: ~c.rlike(v),
    "_iregex": lambda c, v: c.rlike("(?i)" + v),
    "_niregex": lambda c, v: ~c.rlike("(?i)" + v),
    "_similar": lambda c, v: c.rlike(similar_to_regex(v)),
    "_nsimilar": lambda c, v: ~c.rlike(similar_to_regex(v)),
}
_ORDERS = {"asc": "asc_nulls_last", "desc": "desc_nulls_first", **{f"{d}_nulls_{n}": f"{d}_nulls_{n}" for d in ("asc", "desc") for n in ("first", "last")}}
_AGGREGATES = {n: getattr(F, n) for n in ("avg", "max", "min", "stddev", "stddev_pop", "stddev_samp", "sum", "var_pop", "var_samp", "variance")}


@dataclass(frozen=True)
class Relation:
    """child rows whose `theirs` columns equal the parent's `ours`; many: a list, else one row or null."""

    child: str
    ours: tuple[str, ...]
    theirs: tuple[str, ...]
    many: bool = True


def _one(child: str, ours: str, theirs: str = "internal_id") -> Relation:
    return Relation(child, (ours,), (theirs,), False)


_NODE, _BLOCK, _TX = _one("node", "node_internal_id"), _one("block", "block_internal_id"), _one("transaction", "transaction_internal_id")

#: What a ledger's tables lead to. The two outputs of an identity and the data carriers are views of outputs.
RELATIONS: dict[str, dict[str, Relation]] = {
    "block": {"transactions": Relation("block_transaction", ("internal_id",), ("block_internal_id",)), "accepted_by": Relation("node_block", ("internal_id",), ("block_internal_id",)), "previous_block": _one("block", "previous_block_hash", "hash")},
    "block_transaction": {"block": _BLOCK, "transaction": _TX},
    "transaction": {
        "inputs": Relation("input", ("internal_id",), ("transaction_internal_id",)),
        "outputs": Relation("output", ("hash",), ("transaction_hash",)),
        "block_inclusions": Relation("block_transaction", ("internal_id",), ("transaction_internal_id",)),
        "input_outpoint_transactions": Relation("input", ("hash",), ("outpoint_transaction_hash",)),
        "node_validations": Relation("node_transaction", ("internal_id",), ("transaction_internal_id",)),
        "node_validation_timeline": Relation("node_transaction_history", ("internal_id",), ("transaction_internal_id",)),
        "authchains": Relation("authchain_view", ("internal_id",), ("transaction_internal_id",)),
        "data_carrier_outputs": Relation("data_carrier_output", ("hash",), ("transaction_hash",)),
        "identity_output": _one("identity_output", "hash", "transaction_hash"),
        "signing_output": _one("signing_output", "hash", "transaction_hash"),
    },
    "input": {"transaction": _TX, "outpoint": Relation("output", ("outpoint_transaction_hash", "outpoint_index"), ("transaction_hash", "output_index"), False), "outpoint_transaction": _one("output", "outpoint_transaction_hash", "transaction_hash")},
    "output": {"transaction": _one("transaction", "transaction_hash", "hash"), "spent_by": Relation("input", ("transaction_hash", "output_index"), ("outpoint_transaction_hash", "outpoint_index"))},
    "node": {"accepted_blocks": Relation("node_block", ("internal_id",), ("node_internal_id",)), "unconfirmed_transactions": Relation("node_transaction", ("internal_id",), ("node_internal_id",))},
    "node_block": {"node": _NODE, "block": _BLOCK},
    "node_block_history": {"node": _NODE, "block": _BLOCK},
    "node_transaction": {"node": _NODE, "transaction": _TX},
    "node_transaction_history": {"node": _NODE, "transaction": _TX},
    "authchain_view": {"authhead": _one("transaction", "authhead_transaction_hash", "hash"), "migrations": Relation("authchain_migrations_view", ("transaction_internal_id",), ("authbase_internal_id",))},
    "authchain_migrations_view": {"transaction": _one("transaction", "migration_transaction_internal_id")},
}
#: The order that makes a single row of several certain.
_FIRST = {"output": ("output_index",)}
RELATIONS |= dict.fromkeys(("data_carrier_output", "identity_output", "signing_output", "unspent_output", "p2sh_output"), RELATIONS["output"])


@dataclass(frozen=True)
class Query:
    table: str
    columns: tuple[str, ...] | None = None
    filter: Mapping | None = None
    order: tuple[Mapping, ...] = ()
    distinct: tuple[str, ...] = ()
    first: int | None = None
    skip: int = 0
    nested: Mapping[str, Query] = field(default_factory=dict)

    def select(self, *columns: str) -> Query:
        return replace(self, columns=columns)

    def where(self, tree: Mapping) -> Query:
        return replace(self, filter=tree if self.filter is None else {"_and": [self.filter, tree]})

    def order_by(self, *by: Mapping) -> Query:
        return replace(self, order=(*self.order, *by))

    def distinct_on(self, *columns: str) -> Query:
        return replace(self, distinct=columns)

    def limit(self, n: int) -> Query:
        return replace(self, first=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def with_nested(self, **relations: Query) -> Query:
        return replace(self, nested={**self.nested, **relations})


def _named(tree: Mapping) -> set[str]:
    """Columns and relations that a filter names for its own table."""
    out: set[str] = set()
    for key, value in tree.items():
        if key in ("_and", "_or"):
            out |= set().union(*map(_named, value))
        elif key == "_not":
            out |= _named(value)
        else:
            out.add(key)
    return out


Order = tuple[Column, str]  # an expression and the name of its order


def _sorted(order: list[Order]) -> list[Column]:
    return [getattr(c, how)() for c, how in order]


def _called(how: Mapping) -> str:
    """A name for an aggregate: {"count": "desc"} or {"sum": {"value": "desc"}}."""
    (fn, arg), = how.items()
    return fn if isinstance(arg, str) else f"{fn}_{next(iter(arg))}"


def _direction(how: Mapping) -> str:
    (arg,) = how.values()
    return arg if isinstance(arg, str) else next(iter(arg.values()))


class Compiler:
    """Compiles queries over named DataFrames. computed: by table, fields that are added only where a query names them, as
    functions of the table's DataFrame (one function may add several)."""

    def __init__(self, tables: Callable[[str], DataFrame], relations: Mapping[str, Mapping[str, Relation]] = RELATIONS, capped: bool = False, computed: Mapping[str, Mapping[str, Callable[[DataFrame], DataFrame]]] | None = None):
        self.tables, self.relations, self.capped, self.computed = tables, relations, capped, computed or {}

    def _table(self, name: str, used: set[str]) -> DataFrame:
        return self._add(self.tables(name), name, used)

    def _add(self, df: DataFrame, name: str, used: set[str], there: set[str] = frozenset()) -> DataFrame:
        """df with the computed fields that are used, but for those that are there."""
        fields = self.computed.get(name, {})
        done = [f for n, f in fields.items() if n in there]
        for add in dict.fromkeys(f for n, f in fields.items() if n in used and f not in done):
            df = add(df)
        return df

    def compile(self, q: Query) -> DataFrame:
        """Parents are ordered and cut before their children are nested, so that only the children of rows that are
        shown are looked up."""
        df = self._rows(q)
        columns = list(q.columns or self.tables(q.table).columns)
        order, df = self._order(df, q)
        if q.distinct:
            w = Window.partitionBy(*q.distinct).orderBy(*(_sorted(order) or [F.lit(1)]))
            df = df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
        n = self._most(q)
        cut = n is not None or q.skip
        if order:
            df = df.orderBy(*_sorted(order))
        if q.skip:
            df = df.offset(q.skip)
        if n is not None:
            df = df.limit(n)
        if not q.nested:
            return df.select(*columns)
        if cut:
            df = df.withColumn("_row", F.monotonically_increasing_id())
        for name, sub in q.nested.items():
            df = self._attach_few(df, q.table, name, sub) if cut else self._attach(df, q.table, name, sub)
            columns.append(name)
        return (df.orderBy(*_sorted(order)) if order else df).select(*columns)

    def compile_firsts(self, q: Query, orders: Mapping[str, tuple[Mapping, ...]], name: str) -> DataFrame:
        """The rows that come first by q.distinct in each of several orders, with the order's name under `name`: as many compiled
        queries in a union, but aggregates of one relation are made together and rows are dealt to their groups once."""
        df = self._rows(replace(q, order=tuple(by for order in orders.values() for by in order)))
        made: dict[str, Column] = {}
        for rel in dict.fromkeys(key for order in orders.values() for by in order for key in by if key.endswith("_aggregate")):
            hows = [by[rel] for order in orders.values() for by in order if rel in by]
            df = self._aggregates(df, self.relations[q.table][rel.removesuffix("_aggregate")], hows, made, rel)
        # a task sorts its rows once for each order: they are dealt to a stated number of partitions, which AQE doesn't join
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *q.distinct)
        ranks = {}
        for k, (label, order) in enumerate(orders.items()):
            by: list[Order] = []
            for key, how in (item for one in order for item in one.items()):
                if not isinstance(how, str) and not key.endswith("_aggregate"):
                    raise ValueError(f"orders by columns and aggregates only, not by {key}")
                by.append((F.col(key), _ORDERS[how]) if isinstance(how, str) else (made[f"{key}:{_called(how)}"], _ORDERS[_direction(how)]))
            df = df.withColumn(f"_rank{k}", F.row_number().over(Window.partitionBy(*q.distinct).orderBy(*_sorted(by))))
            ranks[label] = F.col(f"_rank{k}") == 1
        first = F.filter(F.array(*[F.when(is_first, F.lit(label)) for label, is_first in ranks.items()]), lambda x: x.isNotNull())
        return df.select(*(q.columns or self.tables(q.table).columns), F.explode(first).alias(name))

    def _aggregates(self, df: DataFrame, rel: Relation, hows: list[Mapping], made: dict[str, Column], name: str) -> DataFrame:
        """df with several aggregates of one relation's rows; made: their columns by name."""
        values: dict[str, Column] = {}
        used: set[str] = set()
        for how in hows:
            (fn, arg), = how.items()
            called = _called(how)
            values[called] = F.count(F.lit(1)) if fn == "count" else _AGGREGATES[fn](next(iter(arg)))
            used |= set() if fn == "count" else set(arg)
            made[f"{name}:{called}"] = F.coalesce(F.col(f"_{name}_{called}"), F.lit(0)) if fn == "count" else F.col(f"_{name}_{called}")
        child = self._table(rel.child, used).groupBy(*[F.col(t).alias(f"_{name}_{i}") for i, t in enumerate(rel.theirs)]).agg(*[v.alias(f"_{name}_{c}") for c, v in values.items()])
        return df.join(child, reduce(Column.__and__, [df[o] == child[f"_{name}_{i}"] for i, o in enumerate(rel.ours)]), "left")

    def _most(self, q: Query) -> int | None:
        sizes = [n for n in (q.first, ROW_CAPS.get(q.table) if self.capped else None) if n is not None]
        return min(sizes, default=None)

    def _rows(self, q: Query) -> DataFrame:
        """Fields that the filter doesn't name are made for the rows that it leaves."""
        used = set(q.columns or ()) | set(q.distinct) | {k for by in q.order for k in by}
        if q.filter is None:
            return self._table(q.table, used)
        first = _named(q.filter)
        return self._add(self._filter(self._table(q.table, first), q.table, q.filter), q.table, used, first)

    def _fits(self, rel: Relation, tree: Mapping) -> DataFrame:
        return self._filter(self._table(rel.child, _named(tree)), rel.child, tree)

    # filters: relations inside the tree become flag columns by semi join keys, then the tree is one condition
    def _filter(self, df: DataFrame, table: str, tree: Mapping) -> DataFrame:
        names = df.columns
        flags: list[str] = []

        def condition(tree: Mapping) -> Column:
            nonlocal df
            parts = []
            for key, value in tree.items():
                if key == "_and":
                    parts.append(reduce(Column.__and__, map(condition, value), F.lit(True)))
                elif key == "_or":
                    parts.append(reduce(Column.__or__, map(condition, value), F.lit(False)))
                elif key == "_not":
                    parts.append(~condition(value))
                elif key in self.relations.get(table, {}):
                    rel = self.relations[table][key]
                    flag = f"_has{len(flags)}_{table}"
                    flags.append(flag)
                    fits = self._fits(rel, value)
                    keys = fits.select(*[F.col(t).alias(f"{flag}_{i}") for i, t in enumerate(rel.theirs)]).distinct().withColumn(flag, F.lit(True))
                    df = df.join(keys, reduce(Column.__and__, [df[o] == keys[f"{flag}_{i}"] for i, o in enumerate(rel.ours)]), "left")
                    parts.append(F.coalesce(F.col(flag), F.lit(False)))
                elif key in names:
                    for op, v in value.items():
                        parts.append(OPERATORS[op](F.col(key), self._value(v)))
                else:
                    raise ValueError(f"{table} has no column or relation {key}")
            return reduce(Column.__and__, parts, F.lit(True))

        plain = self._as_semi_joins(df, table, tree)
        if plain is not None:
            return plain
        where = condition(tree)
        return df.where(where).select(*names)

    def _as_semi_joins(self, df: DataFrame, table: str, tree: Mapping) -> DataFrame | None:
        """A conjunction of relations and columns: semi joins, or anti joins for _not of one relation."""
        rels = self.relations.get(table, {})
        simple, joins = {}, []
        for key, value in tree.items():
            if key in rels:
                joins.append((rels[key], value, "left_semi"))
            elif key == "_not" and len(value) == 1 and next(iter(value)) in rels:
                joins.append((rels[next(iter(value))], next(iter(value.values())), "left_anti"))
            elif key.startswith("_"):
                return None
            else:
                simple[key] = value
        if not joins:
            return None
        if simple:
            df = self._filter(df, table, simple)
        for rel, sub, how in joins:
            fits = self._fits(rel, sub)
            keys = fits.select(*[F.col(t).alias(f"_k{i}") for i, t in enumerate(rel.theirs)])
            df = df.join(keys, reduce(Column.__and__, [df[o] == keys[f"_k{i}"] for i, o in enumerate(rel.ours)]), how)
        return df

    @staticmethod
    def _value(v: Any) -> Any:
        if isinstance(v, str) and v.startswith("\\x"):
            return F.lit(bytearray(bytes.fromhex(v[2:])))
        if isinstance(v, (list, tuple)):
            return [Compiler._value(x) for x in v]
        return v

    def _order(self, df: DataFrame, q: Query) -> tuple[list[Order], DataFrame]:
        out: list[Order] = []
        rels = self.relations.get(q.table, {})
        for by in q.order:
            for key, how in by.items():
                if isinstance(how, str):
                    out.append((F.col(key), _ORDERS[how]))
                elif key.endswith("_aggregate"):
                    df = self._aggregate(df, rels[key.removesuffix("_aggregate")], how, len(out), out)
                else:
                    rel = rels[key]
                    (column, direction), = how.items()
                    name = f"_o{len(out)}"
                    child = self._table(rel.child, {column}).select(*[F.col(t).alias(f"{name}_{i}") for i, t in enumerate(rel.theirs)], F.col(column).alias(name))
                    df = df.join(child, reduce(Column.__and__, [df[o] == child[f"{name}_{i}"] for i, o in enumerate(rel.ours)]), "left")
                    out.append((F.col(name), _ORDERS[direction]))
        return out, df

    def _aggregate(self, df: DataFrame, rel: Relation, how: Mapping, n: int, out: list[Order]) -> DataFrame:
        """how: {"count": "desc"} or {"sum": {"value": "desc"}}."""
        (fn, arg), = how.items()
        name = f"_a{n}"
        value, direction = (F.count(F.lit(1)), arg) if fn == "count" else (_AGGREGATES[fn](next(iter(arg))), next(iter(arg.values())))
        child = self._table(rel.child, set() if fn == "count" else set(arg)).groupBy(*rel.theirs).agg(value.alias(name))
        child = child.select(*[F.col(t).alias(f"{name}_{i}") for i, t in enumerate(rel.theirs)], name)
        df = df.join(child, reduce(Column.__and__, [df[o] == child[f"{name}_{i}"] for i, o in enumerate(rel.ours)]), "left")
        key = F.coalesce(F.col(name), F.lit(0)) if fn == "count" else F.col(name)
        out.append((key, _ORDERS[direction]))
        return df

    def _inner(self, rel: Relation, name: str, q: Query) -> tuple[DataFrame, list[Order], list[str], Column]:
        """Children with what is nested in them: their rows, order, key columns and what is shown of one."""
        q = replace(q, table=rel.child)
        inner = self._rows(q)
        columns = list(q.columns or self.tables(q.table).columns)
        for sub, sq in q.nested.items():
            inner = self._attach(inner, q.table, sub, sq)
            columns.append(sub)
        order, inner = self._order(inner, q)
        if not order and not rel.many:
            order = [(F.col(c), "asc_nulls_last") for c in _FIRST.get(rel.child, ()) if c in inner.columns]
        keys = [f"_n_{name}_{i}" for i in range(len(rel.theirs))]
        return inner.withColumns({k: F.col(t) for k, t in zip(keys, rel.theirs, strict=True)}), order, keys, F.struct(*columns)

    def _attach(self, df: DataFrame, table: str, name: str, q: Query) -> DataFrame:
        """A nested row or list under `name`; lists are ordered and cut within each parent, and empty without rows."""
        rel = self.relations[table][name]
        inner, order, keys, row = self._inner(rel, name, q)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(_sorted(order) or [F.lit(1)])))
        if q.distinct:
            d = F.row_number().over(Window.partitionBy(*keys, *q.distinct).orderBy(*(_sorted(order) or [F.lit(1)])))
            inner = inner.withColumn("_d", d).where("_d = 1")
        most = self._most(replace(q, table=rel.child)) if rel.many else 1
        if order or most is not None or q.skip:
            inner = inner.withColumn("_r", rank)
            if most is not None or q.skip:
                inner = inner.where((F.col("_r") > q.skip) & (F.col("_r") <= q.skip + (most if most is not None else 2**31 - 1 - q.skip)))
        else:
            inner = inner.withColumn("_r", F.lit(0))
        if rel.many:
            one = inner.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", row.alias("x")))), lambda s: s["x"]).alias(name))
        else:
            one = inner.select(*keys, row.alias(name))
        df = df.join(one, reduce(Column.__and__, [df[o] == one[k] for o, k in zip(rel.ours, keys, strict=True)]), "left").drop(*keys)
        if rel.many:
            empty = F.array().cast(one.schema[name].dataType)
            df = df.withColumn(name, F.coalesce(name, empty))
        return df

    def _attach_few(self, df: DataFrame, table: str, name: str, q: Query) -> DataFrame:
        """The same for parents that were cut to a few rows, numbered by `_row`: children are joined to them first, and only
        those are ranked and listed. The parents are read once, so what they were cut to stays the same."""
        rel = self.relations[table][name]
        inner, order, keys, row = self._inner(rel, name, q)
        inner = inner.select(*keys, row.alias("_x"), *[c.alias(f"_by{i}") for i, (c, _) in enumerate(order)], *[F.col(c).alias(f"_of_{c}") for c in q.distinct])
        by = _sorted([(F.col(f"_by{i}"), how) for i, (_, how) in enumerate(order)]) or [F.lit(1)]
        parents = df.select("_row", F.struct(*df.columns).alias("_p"), *[F.col(o).alias(f"_o_{i}") for i, o in enumerate(rel.ours)])
        rows = parents.join(inner, reduce(Column.__and__, [F.col(f"_o_{i}") == F.col(k) for i, k in enumerate(keys)]), "left")
        rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy("_row", *[f"_of_{c}" for c in q.distinct]).orderBy(*by)) if q.distinct else F.lit(1))
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_row").orderBy(F.col("_d") > 1, *by)))
        most = self._most(replace(q, table=rel.child)) if rel.many else 1
        shown = F.col(keys[0]).isNotNull() & (F.col("_d") == 1) & (F.col("_r") > q.skip) & (F.lit(True) if most is None else F.col("_r") <= q.skip + most)
        found = rows.groupBy("_row").agg(F.first("_p").alias("_p"), F.transform(F.sort_array(F.collect_list(F.when(shown, F.struct("_r", "_x")))), lambda s: s["_x"]).alias(name))
        return found.select("_p.*", F.col(name) if rel.many else F.get(name, 0).alias(name))


def stream_page(df: DataFrame, cursor: Mapping[str, tuple[Any, str]], batch_size: int) -> DataFrame:
    """The next batch strictly past a cursor: {column: (last value or None, "asc" or "desc")}, in the columns' order."""
    past, equal = F.lit(False), F.lit(True)
    for c, (last, how) in cursor.items():
        if last is None:
            past, equal = past | equal, F.lit(False)
            break
        past = past | (equal & ((F.col(c) > last) if how == "asc" else (F.col(c) < last)))
        equal = equal & (F.col(c) == last)
    return df.where(past).orderBy(*[getattr(F.col(c), _ORDERS[how])() for c, (_, how) in cursor.items()]).limit(batch_size)


def shown(df: DataFrame) -> DataFrame:
    """Bytes as \\x and hex text, at the top level and in lists of bytes."""

    def show(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.BinaryType):
            return F.concat(F.lit("\\x"), F.lower(F.hex(c)))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: show(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[show(c[f.name], f.dataType).alias(f.name) for f in kind]))
        return c

    return df.select(*[show(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row, as the query layer answers."""
    return shown(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
