"""Predicates built from data: ordered rules, facet filters, guarded ad-hoc SQL, layer views."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("=", "!=", ">=", "<=", "contains", "in")
MOST_ROWS = 200
#: Groups of built-in functions that ad-hoc SQL may call. The one for the rest, which reaches into the machine, is not among them.
FUNCTION_GROUPS = frozenset(
    f"{g}_funcs"
    for g in "agg array bitwise collection predicate conditional conversion csv datetime generator hash json lambda map math string struct url window xml".split()
)
#: What the parser may make of a query: nodes that read, filter, join and group. Commands, scripts, table functions and statements
#: that are text themselves aren't among them.
QUERY_NODES = frozenset(
    "Aggregate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project "
    "ResolvedInlineTable Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases Unpivot "
    "Window WithWindowDefinition".split()
)
#: Names that a query makes from text, which would tell nothing until they are resolved.
NAMES_FROM_TEXT = frozenset(("ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier"))
#: Leaves of an analysed query that hold rows the query itself gives.
ROWS_OF_ITS_OWN = frozenset(("LocalRelation", "OneRowRelation", "CTERelationRef"))
#: Functions that make as much as a number says, with the places of such numbers: plain ones only, up to MOST_MADE.
SIZED_BY = {"sequence": slice(0, None), "array_repeat": slice(1, 2), "repeat": slice(1, 2), "lpad": slice(1, 2), "rpad": slice(1, 2), "space": slice(0, 1)}
MOST_MADE = 10_000


def first_rule(rules: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    name, holds = rules[0]
    out = F.when(holds, name)
    for name, holds in rules[1:]:
        out = out.when(holds, name)
    return out.otherwise(otherwise)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def predicate(df: DataFrame, field: str, op: str, value: object) -> Column:
    """One facet condition: numbers are compared as numbers where the column is numeric, else all as text."""
    if field not in df.columns:
        raise ValueError(f"unknown field {field!r}")
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    c, text = df[field], df[field].cast("string")
    if op == "contains":
        return F.contains(F.lower(text), F.lit(str(value).lower()))
    if op == "in":
        return text.isin([str(v) for v in value])
    numeric = isinstance(df.schema[field].dataType, T.NumericType)
    left, right = (c, F.lit(float(value))) if numeric else (text, F.lit(str(value)))
    return {"=": left == right, "!=": left != right, ">=": left >= right, "<=": left <= right}[op]


def where(df: DataFrame, conditions: Sequence[tuple[str, str, object]], bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """All conditions, and the box (west, south, east, north) over columns x and y if one is given. Each reaches the scan by itself."""
    all_of = [predicate(df, *c) for c in conditions]
    if bbox:
        all_of += [F.col("x").between(bbox[0], bbox[2]), F.col("y").between(bbox[1], bbox[3])]
    return df.filter(reduce(Column.__and__, all_of)) if all_of else df


def _every(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


class _Guard:
    """Walks what Spark's parser made of a statement; whatever isn't known to be harmless is refused."""

    def __init__(self, spark: SparkSession) -> None:
        self.gateway, self.jvm = spark.sparkContext._gateway, spark._jvm
        self.catalog = spark._jsparkSession.sessionState().catalog()

    def _is(self, node, name: str) -> bool:
        return is_instance_of(self.gateway, node, f"org.apache.spark.sql.catalyst.{name}")

    def visit(self, node, known: frozenset[str]) -> None:
        """known: the tables that may be named where the node stands."""
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            # A name holds for what comes after it in its own WITH, and for that WITH's query, nowhere else.
            for pair in _every(node.cteRelations()):
                self.visit(pair._2(), known)
                known = known | {pair._1().lower()}
            self.visit(node.child(), known)
            return
        if self._is(node, "plans.logical.LogicalPlan") and kind not in QUERY_NODES:
            raise ValueError(f"{kind} is no part of a plain query")
        if kind in NAMES_FROM_TEXT:
            raise ValueError("names can't be made from text")
        if kind == "UnresolvedRelation":
            name = node.multipartIdentifier()
            if name.size() != 1 or name.apply(0).lower() not in known:
                raise ValueError(f"{node.tableName()} is not one of the tables")
        if kind == "UnresolvedFunction":
            self._function(node)
        parts = _every(node.children()) + _every(node.innerChildren())
        if self._is(node, "plans.QueryPlan"):
            parts += _every(node.expressions())
        for part in parts:
            self.visit(part, known)

    def _function(self, node) -> None:
        name = node.nameParts()
        try:
            info = self.catalog.lookupFunctionInfo(self.jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name.apply(0))) if name.size() == 1 else None
        except Exception:
            info = None
        if info is None or info.getGroup() not in FUNCTION_GROUPS:
            raise ValueError(f"{name.mkString('.')} can't be called")
        if (places := SIZED_BY.get(name.apply(0).lower())) is not None:
            arguments = _every(node.arguments())
            sizes = [self._number(a) for a in (arguments[places] if places.stop is None or len(arguments) >= places.stop else arguments)]
            if None in sizes or max(map(abs, sizes), default=0) > MOST_MADE:
                raise ValueError(f"{name.apply(0)} takes plain numbers up to {MOST_MADE} here")

    def _number(self, node) -> int | None:
        if self._is(node, "expressions.UnaryMinus"):
            node = node.child()
        value = node.value() if self._is(node, "expressions.Literal") else None
        return value if isinstance(value, int) else None


    def relations(self, df: DataFrame) -> list:
        """Leaves of the analysed plan, those of subqueries included, that don't hold rows of the query's own."""
        out, waiting = [], [df._jdf.queryExecution().analyzed()]
        while waiting:
            node = waiting.pop()
            below = _every(node.children())
            if self._is(node, "plans.logical.LeafNode") and node.getClass().getSimpleName() not in ROWS_OF_ITS_OWN:
                out.append(node.canonicalized())
            waiting += below + _every(node.innerChildren())
            if self._is(node, "plans.QueryPlan"):
                waiting += _every(node.expressions())
        return out


def check_sql(spark: SparkSession, sql: str, tables: Collection[str]) -> str:
    """The statement, if Spark's parser takes it as one query made of QUERY_NODES over these tables, and functions of
    FUNCTION_GROUPS, alone."""
    text = sql.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as wrong:
        raise ValueError(f"not one query: {str(wrong).splitlines()[0]}") from wrong
    _Guard(spark).visit(plan, frozenset(t.lower() for t in tables))
    return text


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], most: int = MOST_ROWS) -> DataFrame:
    """Guarded ad-hoc SQL over the given tables only; one row more than `most` shows that there are more. Views of the caller's that
    have the names of tables are as before afterwards: the query is bound to its tables when it is made. What it was bound to is
    looked at once more: every relation must be one of the given tables' own."""
    text = check_sql(spark, sql, tables)
    own = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in tables if name in own}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        made = spark.sql(text)
        guard = _Guard(spark)
        given = [leaf for df in tables.values() for leaf in guard.relations(df)]
        if not all(any(leaf.equals(g) for g in given) for leaf in guard.relations(made)):
            raise ValueError("the query reads what is not one of the tables")
        return made.limit(most + 1)
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def layer(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A view of a table under the names that readers use."""
    return df.select(*[F.col(c).alias(name) for name, c in columns.items()])
