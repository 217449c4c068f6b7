"""Document-store selectors and aggregation pipelines compiled to DataFrame plans.

Exactly the operators listed in ``SELECTOR_OPERATORS``, ``STAGES`` and
``ACCUMULATORS`` are known; any other raises ``UnsupportedOperator``. Field names
are document names (``bold:animal``, ``@type``); ``column_of`` finds the column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.runtime import materialize

SELECTOR_OPERATORS = ("$eq", "$in", "$nin", "$exists", "$gte", "$gt", "$lt", "$lte", "$or", "$and")
STAGES = ("$match", "$unwind", "$group", "$sort", "$limit", "$facet", "$project")
ACCUMULATORS = ("$sum", "$avg", "$min", "$max", "$addToSet", "$push", "$top")

#: Ids of an $in list up to which it stays an expression; longer lists become a semi-join.
MAX_INLINE_IDS = 1_000


class UnsupportedOperator(ValueError):
    pass


def column_name(df: DataFrame, field: str) -> str | None:
    """The column that holds a document field: as named, or in lower case with ``:`` as ``_``."""
    low = field.lower()
    names = [field, low.replace(":", "_"), "at_" + low[1:] if field.startswith("@") else low, low.split(":")[-1]]
    if low == "dcterms:ispartof":
        names += ["is_part_of", "partitions"]
    for n in names:
        if n in df.columns:
            return n
    return None


def column_of(df: DataFrame, field: str) -> tuple[Column, T.DataType | None]:
    """(column, type) of a field; a field without a column is read from the JSON text ``doc``, else it is missing."""
    name = column_name(df, field)
    if name is not None:
        return F.col(f"`{name}`"), df.schema[name].dataType
    if "doc" in df.columns:
        return F.get_json_object("doc", "$['" + field.replace("'", "\\'") + "']"), None
    return F.lit(None), T.NullType()


def selector(df: DataFrame, spec: dict | None) -> Column:
    """The predicate of a selector; it is never null."""
    parts = []
    for key, value in (spec or {}).items():
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)) or not value:
                raise UnsupportedOperator(f"{key} needs a list of selectors")
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), [selector(df, v) for v in value]))
        elif key.startswith("$"):
            raise UnsupportedOperator(key)
        else:
            parts.append(_field(df, key, value))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _field(df: DataFrame, field: str, value) -> Column:
    col, kind = column_of(df, field)
    if isinstance(value, dict) and any(k.startswith("$") for k in value):
        return reduce(lambda a, b: a & b, [_operator(df, field, col, kind, op, v) for op, v in value.items()])
    return _equals(col, kind, value)


def _equals(col: Column, kind, value) -> Column:
    """A scalar equals the value, an array holds it; None is null or missing."""
    if value is None:
        return col.isNull()
    if isinstance(kind, T.ArrayType):
        if isinstance(value, (list, tuple)):
            return F.coalesce(col == F.array(*[F.lit(v) for v in value]), F.lit(False))
        return F.coalesce(F.array_contains(col, F.lit(value)), F.lit(False))
    if kind is None and isinstance(value, str):
        inside = F.array_contains(F.from_json(col, "array<string>"), F.lit(value))
        return F.coalesce(F.when(col.startswith("["), inside).otherwise(col == F.lit(value)), F.lit(False))
    return F.coalesce(col == F.lit(value), F.lit(False))


def _operator(df: DataFrame, field: str, col: Column, kind, op: str, value) -> Column:
    if op == "$eq":
        return _equals(col, kind, value)
    if op in ("$in", "$nin"):
        values = list(value)
        known = [v for v in values if v is not None]
        if isinstance(kind, T.ArrayType):
            hit = F.arrays_overlap(col, F.array(*[F.lit(v) for v in known])) if known else F.lit(False)
        else:
            hit = col.isin(known) if known else F.lit(False)
        hit = F.coalesce(hit, F.lit(None in values))
        return hit if op == "$in" else ~hit
    if op == "$exists":
        if column_name(df, field) is None and "doc" in df.columns:
            there = F.coalesce(F.array_contains(F.json_object_keys("doc"), field), F.lit(False))
        else:
            there = col.isNotNull()
        return there if value else ~there
    compare = {"$gte": lambda: col >= F.lit(value), "$gt": lambda: col > F.lit(value), "$lte": lambda: col <= F.lit(value), "$lt": lambda: col < F.lit(value)}
    if op in compare:
        if kind is None:
            col = col.try_cast("double")
            compare = {"$gte": lambda: col >= value, "$gt": lambda: col > value, "$lte": lambda: col <= value, "$lt": lambda: col < value}
        return F.coalesce(compare[op](), F.lit(False))
    raise UnsupportedOperator(op)


def find(df: DataFrame, spec: dict | None = None, projection: list[str] | dict | None = None, sort: list[tuple[str, int]] | dict | None = None, limit: int | None = None) -> DataFrame:
    """A find with the options of a query: ``sort`` breaks ties by ``_id``, ``projection`` keeps ``_id``."""
    ids = (spec or {}).get("_id")
    if isinstance(ids, dict) and set(ids) == {"$in"} and len(ids["$in"]) > MAX_INLINE_IDS:
        wanted = df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids["$in"])], "_id string")
        df, spec = df.join(wanted, "_id", "left_semi"), {k: v for k, v in spec.items() if k != "_id"}
    out = df.where(selector(df, spec))
    if sort:
        out = _sorted(out, sort)
    if limit is not None:
        out = out.limit(limit)
    return project(out, projection) if projection else out


def _sorted(df: DataFrame, sort) -> DataFrame:
    pairs = list(sort.items()) if isinstance(sort, dict) else list(sort)
    keys = [F.asc_nulls_first(column_of(df, f)[0]) if d > 0 else F.desc_nulls_last(column_of(df, f)[0]) for f, d in pairs]
    if "_id" in df.columns and all(f != "_id" for f, _ in pairs):
        keys.append(F.asc("_id"))
    return df.orderBy(*keys)


def project(df: DataFrame, projection) -> DataFrame:
    """Only the named fields, or all but those set to 0; ``_id`` stays."""
    spec = projection if isinstance(projection, dict) else {f: 1 for f in projection}
    if spec and not any(spec.values()):
        return df.drop(*[column_name(df, f) or f for f in spec if f != "_id"])
    keep = (["_id"] if "_id" in df.columns and spec.get("_id", 1) else []) + [f for f, on in spec.items() if on and f != "_id"]
    return df.select([column_of(df, f)[0].alias(column_name(df, f) or f) for f in keep])


def aggregate(df: DataFrame, pipeline: list[dict]):
    """Runs a pipeline; ``$facet`` (last stage only) gives a dict of DataFrames."""
    for i, stage in enumerate(pipeline):
        if len(stage) != 1:
            raise UnsupportedOperator(f"a stage has one operator: {sorted(stage)}")
        op, arg = next(iter(stage.items()))
        if op == "$match":
            df = df.where(selector(df, arg))
        elif op == "$unwind":
            df = unwind(df, arg)
        elif op == "$group":
            df = group(df, arg)
        elif op == "$sort":
            df = _sorted(df, arg)
        elif op == "$limit":
            df = df.limit(arg)
        elif op == "$project":
            df = project(df, arg)
        elif op == "$facet":
            if i + 1 != len(pipeline):
                raise UnsupportedOperator("$facet must be the last stage")
            # Every facet reads what the stages before gave, so that is written once if there were any.
            shared = materialize(df) if i and len(arg) > 1 else df
            return {name: aggregate(shared, p) for name, p in arg.items()}
        else:
            raise UnsupportedOperator(op)
    return df


def unwind(df: DataFrame, arg) -> DataFrame:
    """One row an element; a scalar is its own element; missing and empty give none unless preserved."""
    path, keep = (arg, False) if isinstance(arg, str) else (arg["path"], arg.get("preserveNullAndEmptyArrays", False))
    name = column_name(df, path.lstrip("$"))
    if name is None:
        return df if keep else df.where("false")
    if not isinstance(df.schema[name].dataType, T.ArrayType):
        return df if keep else df.where(F.col(f"`{name}`").isNotNull())
    explode = F.explode_outer if keep else F.explode
    return df.withColumn(name, explode(F.col(f"`{name}`")))


def _value(df: DataFrame, expr):
    if isinstance(expr, str) and expr.startswith("$"):
        return column_of(df, expr[1:])[0]
    if isinstance(expr, (list, tuple)):
        return F.array_compact(F.array(*[_value(df, e) for e in expr]))
    if isinstance(expr, dict):
        return F.struct(*[_value(df, e).alias(k) for k, e in expr.items()])
    return F.lit(expr)


def _top(df: DataFrame, sort: list[tuple[str, int]], output: Column) -> Column:
    """The output of the first row by several fields; nulls come first in ascending order and last in descending.

    Fields that go against the direction of the first are turned by their sign, so they must be numbers or times.
    """
    if len(sort) == 1:
        return (F.max_by if sort[0][1] < 0 else F.min_by)(output, column_of(df, sort[0][0])[0])
    keys = []
    for field, direction in sort:
        col, kind = column_of(df, field)
        if direction != sort[0][1]:
            if not isinstance(kind, (T.NumericType, T.TimestampType, T.DateType)):
                raise UnsupportedOperator(f"$top can not sort {field} against the direction of the first field")
            col = F.negative(col if isinstance(kind, T.NumericType) else F.unix_micros(col.cast("timestamp")))
            keys += [col.isNull(), col]
        else:
            keys += [col.isNotNull(), col]
    return (F.max_by if sort[0][1] < 0 else F.min_by)(output, F.struct(*keys))


def group(df: DataFrame, spec: dict) -> DataFrame:
    """``_id`` null groups all rows; an object groups by its fields; a missing key is the null group."""
    key, aggs = spec["_id"], []
    for name, acc in spec.items():
        if name == "_id":
            continue
        if not isinstance(acc, dict) or len(acc) != 1:
            raise UnsupportedOperator(f"{name}: {acc!r}")
        op, arg = next(iter(acc.items()))
        if op == "$sum":
            a = F.count(F.lit(1)) if arg == 1 else F.coalesce(F.sum(_value(df, arg)), F.lit(0))
        elif op == "$avg":
            a = F.avg(_value(df, arg))
        elif op == "$min":
            a = F.min(_value(df, arg))
        elif op == "$max":
            a = F.max(_value(df, arg))
        elif op == "$addToSet":
            a = F.array_sort(F.collect_set(_value(df, arg)))
        elif op == "$push":
            a = F.collect_list(_value(df, arg))
        elif op == "$top":
            a = _top(df, list(arg["sortBy"].items()), _value(df, arg["output"]))
        else:
            raise UnsupportedOperator(op)
        aggs.append(a.alias(name))
    if key is None:
        return df.agg(*aggs).select(F.lit(None).cast("string").alias("_id"), "*")
    return df.groupBy(_value(df, key).alias("_id")).agg(*aggs or [F.count(F.lit(1)).alias("__n")]).drop("__n")
