"""Queries that Spark plans wrongly, put otherwise before they run. The rows stay those of their SQL.

- An ordered LIMIT or OFFSET of a correlated subquery whose order isn't among its columns: Spark numbers the rows of
  each key in the order in which they arrive, since the columns hide the order. The columns are taken after the limit.
- ROW_NUMBER over all rows: Spark sorts them in one task. They are dealt by ranges of the order, and numbered in each range
  from the count of rows before it. Dealing and counting are jobs that run at once. Within subqueries it is left to Spark,
  and where the optimizer finds that only the first rows are asked for.
- COUNT(*) over all rows by RANGE of one column: Spark sorts them in one task. Rows of one value have one result, so the
  window runs over the values and their counts, and is joined to the rows. The input is read twice. Not within subqueries.
- APPROX_COUNT_DISTINCT beside aggregates of DISTINCT values: Spark holds a sketch for each distinct value in each task.
  The DISTINCT aggregates are computed apart, and joined by the grouping. The input is read twice. Not within subqueries.

Analyzed plans are rebuilt node by node; what isn't named here stays as it is.
"""

from __future__ import annotations

import uuid
from functools import cached_property, reduce
from itertools import accumulate
from operator import and_

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By Spark's estimate, which for Parquet is of compressed bytes: a range has a few 100,000 rows.
RANGE_BYTES, MAX_RANGES = 1 << 20, 2000
_SUBQUERY = "org.apache.spark.sql.catalyst.expressions.SubqueryExpression"
_SKETCH = "org.apache.spark.sql.catalyst.expressions.aggregate.HyperLogLogPlusPlus"
_EXPRESSION = "org.apache.spark.sql.catalyst.expressions.Expression"


def mended(df: DataFrame) -> DataFrame:
    """The same rows, by a plan that gives them on any number of executors."""
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().analyzed()
    m = _Mender(df)
    new = m.plan(plan) if m.concerned(plan) else plan
    return df if new is plan else m.frame(new)


def _items(seq: JavaObject) -> list[JavaObject]:
    return [seq.apply(i) for i in range(seq.size())]


class _Mender:
    def __init__(self, df: DataFrame):
        self.df, self.spark = df, df.sparkSession
        self.gateway, self.jvm = self.spark.sparkContext._gateway, self.spark._jvm
        self.patterns = self.jvm.org.apache.spark.sql.catalyst.trees.TreePattern

    def concerned(self, node: JavaObject) -> bool:
        return any(node.containsPattern(p) for p in (self.patterns.PLAN_EXPRESSION(), self.patterns.WINDOW(), self.patterns.AGGREGATE()))

    def frame(self, plan: JavaObject) -> DataFrame:
        return DataFrame(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def seq(self, items: list) -> JavaObject:
        return self.jvm.org.apache.spark.api.python.PythonUtils.toSeq(items)

    def plan(self, node: JavaObject) -> JavaObject:
        if not self.concerned(node):
            return node
        new = self._subqueries(self._each(node, self.plan))
        if node.nodeName() == "Window" and self._numbers_all(node):
            return self._numbered(new, self.frame(node.child())._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if node.nodeName() == "Window" and self._counts_all(node):
            return self._counted(new)
        if node.nodeName() == "Aggregate" and node.deterministic() and node.child().deterministic():
            return self._apart(new)
        return new

    def made(self, node: JavaObject, items: list) -> JavaObject:
        """A plan's node of the same kind, made of these."""
        args = self.gateway.new_array(self.jvm.Object, len(items))
        for i, x in enumerate(items):
            args[i] = x
        return node.makeCopy(args)

    def alias(self, e: JavaObject, like: JavaObject | None = None) -> JavaObject:
        """An expression under another's name and id, or under new ones."""
        made, nothing = self.jvm.org.apache.spark.sql.catalyst.expressions, self.seq([])
        name, new = (like.name(), like.exprId()) if like else ("v", made.NamedExpression.newExprId())
        return made.Alias(e, name, new, nothing, self.jvm.scala.Option.empty(), nothing)

    def project(self, items: list[JavaObject], child: JavaObject) -> JavaObject:
        return self.jvm.org.apache.spark.sql.catalyst.plans.logical.Project(self.seq(items), child)

    def column(self, e: JavaObject) -> Column:
        return Column(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e))

    def _each(self, node: JavaObject, f) -> JavaObject:
        """The node with f of its children; itself if f changes none."""
        old = _items(node.children())
        new = [f(c) for c in old]
        return node if all(a is b for a, b in zip(old, new)) else node.withNewChildren(self.seq(new))

    # -- ordered limits of subqueries

    def _subqueries(self, node: JavaObject) -> JavaObject:
        """The plan's node with its subqueries mended."""
        if not any(map(self.concerned, _items(node.expressions()))):
            return node
        old = [node.productElement(i) for i in range(node.productArity())]
        new = [self._argument(x) for x in old]
        if all(a is b for a, b in zip(old, new)):
            return node
        return self.made(node, new)

    def _argument(self, x):
        """What a plan's node was made of: an expression, some of them, or something else, which stays."""
        if not isinstance(x, JavaObject):
            return x
        if is_instance_of(self.gateway, x, _EXPRESSION):
            return self._expression(x)
        for kind, wrap in (("scala.collection.immutable.Seq", self.seq), ("scala.Some", lambda xs: self.jvm.scala.Option.apply(xs[0]))):
            if is_instance_of(self.gateway, x, kind):
                old = _items(x) if kind.endswith("Seq") else [x.get()]
                new = [self._argument(y) for y in old]
                return x if all(a is b for a, b in zip(old, new)) else wrap(new)
        return x

    def _expression(self, e: JavaObject) -> JavaObject:
        if not self.concerned(e):
            return e
        e = self._each(e, self._expression)
        if is_instance_of(self.gateway, e, _SUBQUERY):
            old = e.plan()
            new = self._ordered(self._within(old))
            return e if new is old else e.withNewPlan(new)
        return e

    def _within(self, node: JavaObject) -> JavaObject:
        """A subquery's plan with its own subqueries mended."""
        return self._subqueries(self._each(node, self._within)) if self.concerned(node) else node

    def _ordered(self, node: JavaObject) -> JavaObject:
        """A subquery's plan with the columns between each limit and its order taken after the limit."""
        limits, columns, below = [], [], node
        while below.nodeName() in ("GlobalLimit", "LocalLimit", "Offset"):
            limits.append(below)
            below = below.child()
        if not limits:
            return self._each(node, self._ordered)
        while below.nodeName() in ("Project", "SubqueryAlias"):
            columns.append(below)
            below = below.child()
        if not columns or below.nodeName() != "Sort":
            return self._each(node, self._ordered)
        out = self._each(below, self._ordered)
        for outer in reversed(columns + limits):
            out = outer.withNewChildren(self.seq([out]))
        return out

    # -- numbers of all rows

    @cached_property
    def _sorted_whole(self) -> set[int]:
        """Ids of the columns whose window still sorts all rows after the optimizer."""
        out, todo = set(), [self.df._jdf.queryExecution().optimizedPlan()]
        while todo:
            node = todo.pop()
            todo += _items(node.children())
            if node.nodeName() == "Window" and node.child().nodeName() not in ("GlobalLimit", "LocalLimit", "WindowGroupLimit"):
                out |= {e.exprId().id() for e in _items(node.windowExpressions())}
        return out

    def _over_all(self, window: JavaObject, told) -> bool:
        """Whether a window sorts all rows, for nothing but functions of one kind."""
        if window.partitionSpec().nonEmpty() or window.orderSpec().isEmpty() or not window.child().deterministic():
            return False
        found = _items(window.windowExpressions())
        if any(e.nodeName() != "Alias" or e.child().nodeName() != "WindowExpression" or not told(e.child()) for e in found):
            return False
        return any(e.exprId().id() in self._sorted_whole for e in found)

    def _numbers_all(self, window: JavaObject) -> bool:
        return self._over_all(window, lambda e: e.windowFunction().getClass().getSimpleName() == "RowNumber")

    def _numbered(self, window: JavaObject, size: int) -> JavaObject:
        """The window's rows and columns. The ranges are those of one shuffle, which is counted and then read again; rows equal in the order are dealt by where they were read."""
        child, mark = window.child(), f"_{uuid.uuid4().hex}"
        order = [self.column(o) for o in _items(window.orderSpec())]
        dealt = self.frame(child).select("*", F.monotonically_increasing_id().alias(mark)).repartitionByRange(min(1 + size // RANGE_BYTES, MAX_RANGES), *order, F.col(mark)).drop(mark)
        kept = DataFrame(self.spark._jsparkSession.internalCreateDataFrame(dealt._jdf.queryExecution().toRdd(), dealt._jdf.schema(), False), self.spark)
        place = F.monotonically_increasing_id()
        counts = dict(kept.select(F.shiftright(place, 33).alias("range")).groupBy("range").count().collect())
        before = list(accumulate((counts.get(i, 0) for i in range(max(counts, default=0) + 1)), initial=0))
        plan = kept._jdf.queryExecution().analyzed()
        back = self.frame(self.project([self.alias(new, old) for new, old in zip(_items(plan.output()), _items(child.output()))], plan))
        placed = back.sortWithinPartitions(*order).select("*", place.alias(mark))
        number = F.get(F.lit(before).cast("array<bigint>"), F.shiftright(mark, 33).cast("int")) + F.col(mark).bitwiseAND((1 << 33) - 1) + 1
        plan = placed.select("*", number.cast("int").alias("n"))._jdf.queryExecution().analyzed()
        n = _items(plan.output())[-1]
        return self.project(_items(child.output()) + [self.alias(n, e) for e in _items(window.windowExpressions())], plan)

    # -- counts of all rows by range

    def _counts_all(self, window: JavaObject) -> bool:
        def told(e: JavaObject) -> bool:
            f, frame = e.windowFunction(), e.windowSpec().frameSpecification()
            if f.nodeName() != "AggregateExpression" or f.isDistinct() or f.filter().isDefined() or frame.frameType().toString() != "RangeFrame":
                return False
            f = f.aggregateFunction()
            return f.getClass().getSimpleName() == "Count" and all(c.nodeName() == "Literal" and not c.nullable() for c in _items(f.children()))

        return window.orderSpec().size() == 1 and self._over_all(window, told)

    def _counted(self, window: JavaObject) -> JavaObject:
        """The window's rows and columns, by way of the counts of each value."""
        made, order = self.jvm.org.apache.spark.sql.catalyst.expressions, window.orderSpec().apply(0)
        rows, value = self.frame(window.child()), self.column(order.child())
        values = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
        v, n = _items(values._jdf.queryExecution().analyzed().output())
        by = self.seq([made.SortOrder(v, order.direction(), order.nullOrdering(), self.seq([]))])
        total = made.aggregate.Sum(n).toAggregateExpression()
        sums = [made.WindowExpression(total, made.WindowSpecDefinition(self.seq([]), by, e.child().windowSpec().frameSpecification())) for e in _items(window.windowExpressions())]
        counts = values.select(self.column(v), *[F.coalesce(self.column(e), F.lit(0)).cast("bigint").alias(f"n{i}") for i, e in enumerate(sums)])
        plan = rows.join(counts, value.eqNullSafe(self.column(v)))._jdf.queryExecution().analyzed()
        columns = _items(plan.output())
        width = window.child().output().size()
        return self.project([self.alias(c, old) for c, old in zip(columns, _items(window.child().output()))] + [self.alias(c, e) for c, e in zip(columns[width + 1 :], _items(window.windowExpressions()))], plan)

    # -- distinct values beside sketches

    def _apart(self, node: JavaObject) -> JavaObject:
        """The aggregate as a join of two: of DISTINCT values, and the others."""
        keys, found = _items(node.groupingExpressions()), []

        def collect(e: JavaObject) -> None:
            if e.nodeName() != "AggregateExpression":
                for c in _items(e.children()):
                    collect(c)
            elif not any(e.semanticEquals(f) for f in found):
                found.append(e)

        outputs = _items(node.aggregateExpressions())
        for e in outputs:
            collect(e)
        sides = [[e for e in found if e.isDistinct() == distinct] for distinct in (True, False)]
        if not sides[0] or not any(is_instance_of(self.gateway, e.aggregateFunction(), _SKETCH) for e in sides[1]):
            return node
        parts = [node.productElement(i) for i in range(node.productArity())]
        left, right = (self.frame(self.made(node, [parts[0], self.seq([self.alias(e) for e in keys + side]), *parts[2:]])) for side in sides)
        ids = [[self.column(a) for a in _items(f._jdf.queryExecution().analyzed().output())] for f in (left, right)]
        same = [a.eqNullSafe(b) for a, b in list(zip(*ids))[: len(keys)]]
        plan = (left.join(right, reduce(and_, same)) if same else left.crossJoin(right))._jdf.queryExecution().analyzed()
        columns = _items(plan.output())
        known = list(zip(keys + sides[0], columns)) + list(zip(sides[1], columns[len(ids[0]) + len(keys) :]))

        def put(e: JavaObject) -> JavaObject:
            return next((c for k, c in known if e.semanticEquals(k)), None) or self._each(e, put)

        return self.project([self._each(e, put) if e.nodeName() == "Alias" else self.alias(put(e), e) for e in outputs], plan)
