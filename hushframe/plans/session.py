"""Budget sessions: every answer is paid for before any job starts, and computed once."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.calibration import advanced_epsilon, approx_to_zcdp
from hushframe.functions.noise import Noise, SecureNoise
from hushframe.operators import histograms, private, resize
from hushframe.operators.bounding import ROW, PrivacyUnit, bound_partitions
from hushframe.operators.keysets import join_public, public_multiplicity
from hushframe.operators.vectors import dp_vector_sum
from hushframe.plans.adaptive import two_phase_count
from hushframe.plans.charges import Charges
from hushframe.plans.ledger import SPENDS, split_total
from hushframe.plans.materialise import noting_intermediates, remove


class BudgetExceeded(Exception):
    """The query would spend more than what is left."""


class UnsafeStep(ValueError):
    """A step of a query could let one row change many rows."""


#: Copies of the privacy unit and the row key travel under names that steps cannot touch.
HIDDEN = "__private_"

#: A step takes the rows and the hidden columns, and returns rows that have them still.
Step = Callable[[DataFrame, Sequence[str]], DataFrame]


#: Statistics of a whole view, which take no groups.
UNGROUPED = ("histogram", "sparse_histogram", "vector_sum", "sum_sized", "mean_sized", "variance_sized", "two_phase_count")
SIZED = {
    "sum_sized": resize.dp_sum_sized,
    "mean_sized": resize.dp_mean_sized,
    "variance_sized": resize.dp_variance_sized,
}
MEASURES = ("pure", "zcdp", "approx")


#: Functions that come from outside Spark could carry something from row to row.
FOREIGN = ("PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaUDF", "ScalaAggregator", "HiveSimpleUDF", "HiveGenericUDF")


def _per_row(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` if it only filters rows of ``before`` and computes columns from one row each.

    Whatever else a step's expressions need, windows, aggregates, generators or subqueries, shows up in the
    analysed plan as another operator. An expression whose value depends on chance, on the row's place or on its
    file is not deterministic to Spark: with it one row more could change what becomes of all others.
    """
    base, node = before._jdf.queryExecution().analyzed(), after._jdf.queryExecution().analyzed()
    while not node.equals(base):
        kind = node.getClass().getSimpleName()
        if kind not in ("Project", "Filter") or not node.subqueries().isEmpty():
            raise UnsafeStep(f"a step may only look at one row at a time, not run {kind} or a subquery")
        expressions = node.expressions()
        for i in range(expressions.size()):
            _refuse_unstable(expressions.apply(i))
        node = node.child()
    return after


def _refuse_unstable(expression) -> None:
    if not expression.deterministic():
        raise UnsafeStep(f"a step may not depend on chance or on where a row lies: {expression.sql()}")
    waiting = [expression]
    while waiting:
        one = waiting.pop()
        if one.getClass().getSimpleName() in FOREIGN:
            raise UnsafeStep(f"a step may only use functions of Spark, not {one.toString()}")
        children = one.children()
        waiting.extend(children.apply(i) for i in range(children.size()))


@dataclass(frozen=True)
class Query:
    """A private query on a named view: row steps, then one statistic.

    Steps filter rows or compute columns from one row. What makes several rows out of one has a step
    of its own that declares the factor, and the influence of a row is multiplied by it. The privacy unit and
    the row key are those of the view, whatever steps select, rename or replace. ``delta`` is what the
    query costs beside its epsilon, in an (epsilon, delta) session.
    """

    view: str
    steps: tuple[Step, ...] = ()
    factors: tuple[Callable[[], int], ...] = ()
    keyset: DataFrame | None = None
    found: tuple[str, ...] = ()
    delta: float = 0.0
    metric: str | None = None
    options: Mapping[str, object] = field(default_factory=dict)

    def _then(self, step: Step, *factors: Callable[[], int]) -> Query:
        return replace(self, steps=(*self.steps, step), factors=(*self.factors, *factors))

    def filter(self, predicate: str) -> Query:
        return self._then(lambda df, hidden: _per_row(df, df.filter(predicate)))

    def select(self, *columns: str) -> Query:
        return self._then(lambda df, hidden: _per_row(df, df.select(*columns, *hidden)))

    def rename(self, names: Mapping[str, str]) -> Query:
        return self._then(lambda df, hidden: df.withColumnsRenamed(dict(names)))

    def with_column(self, name: str, expression: str) -> Query:
        return self._then(lambda df, hidden: _per_row(df, df.withColumn(name, F.expr(expression))))

    def drop_missing(self, *columns: str) -> Query:
        """Rows without NULL (or NaN) in these columns."""
        return self._then(lambda df, hidden: df.dropna(subset=list(columns)))

    def fill_missing(self, values: Mapping[str, object]) -> Query:
        """A value instead of NULL (or NaN) in each of these columns."""
        return self._then(lambda df, hidden: df.fillna(dict(values)))

    def explode(self, name: str, expression: str, at_most: int) -> Query:
        """One row per element of an array, of which the first ``at_most`` count."""
        if at_most < 1:
            raise ValueError("a row must be able to become at least one row")

        def step(df: DataFrame, hidden: Sequence[str]) -> DataFrame:
            array = _per_row(df, df.withColumn(name, F.expr(expression)))
            return array.withColumn(name, F.explode(F.slice(name, 1, at_most)))

        return self._then(step, lambda: at_most)

    def join_public(self, public: DataFrame, on: Sequence[str]) -> Query:
        """Join with a public table. How often a key occurs there is counted once the query has been paid for."""

        def step(df: DataFrame, hidden: Sequence[str]) -> DataFrame:
            if any(c.startswith(HIDDEN) for c in public.columns):
                raise UnsafeStep(f"a public table has a column whose name begins with {HIDDEN}")
            return join_public(df, public, on)

        return self._then(step, lambda: max(public_multiplicity(public, on), 1))

    def group_by(self, keyset: DataFrame) -> Query:
        return replace(self, keyset=keyset, found=())

    def group_by_found(self, columns: Sequence[str], delta: float) -> Query:
        """Groups whose keys are found in the private rows; ``delta`` and half of the epsilon pay for showing them."""
        return replace(self, keyset=None, found=tuple(columns), delta=_spare(delta))

    def found_keys(self) -> Query:
        """Only the keys, with the noisy number of units that have them; takes the whole epsilon."""
        return self._metric("found_keys")

    def count(self) -> Query:
        return self._metric("count")

    def privacy_id_count(self) -> Query:
        return self._metric("privacy_id_count")

    def sum(self, column: str, low: float, high: float) -> Query:
        return self._metric("sum", value=column, low=low, high=high)

    def average(self, column: str, low: float, high: float) -> Query:
        return self._metric("mean", value=column, low=low, high=high)

    def variance(self, column: str, low: float, high: float) -> Query:
        return self._metric("variance", value=column, low=low, high=high)

    def stdev(self, column: str, low: float, high: float) -> Query:
        return self._metric("std", value=column, low=low, high=high)

    def count_nonzero(self, column: str) -> Query:
        return self._metric("count_nonzero", what=column)

    def aggregate(
        self, metrics: Sequence[str], column: str | None = None, low: float | None = None, high: float | None = None,
        weights: Mapping[str, float] | None = None,
    ) -> Query:
        """Several statistics from one pass over the rows; the epsilon is shared among them by weight."""
        return self._metric("aggregate", metrics=list(metrics), value=column, low=low, high=high, weights=weights)

    def histogram(self, *axes: histograms.Axis) -> Query:
        """Counts of all cells of a public grid."""
        return self._metric("histogram", axes=axes)

    def sparse_histogram(self, *axes: histograms.Axis, delta: float) -> Query:
        """Counts of the cells that enough units have, of a grid too large to list."""
        return replace(self._metric("sparse_histogram", axes=axes), delta=_spare(delta))

    def quantiles(self, axis: histograms.Axis, quantiles: Sequence[float]) -> Query:
        return self._metric("quantiles", axis=axis, quantiles=list(quantiles))

    def vector_sum(self, column: str, dim: int, clip: float, norm: str = "l1", delta: float | None = None) -> Query:
        """Sum of clipped vectors; an L2 clip takes Gaussian noise, so a rho or a ``delta``."""
        asked = self._metric("vector_sum", c=column, dim=dim, clip=clip, norm=norm)
        return asked if delta is None else replace(asked, delta=_spare(delta))

    def sum_sized(self, column: str, low: float, high: float, n: int) -> Query:
        return self._metric("sum_sized", c=column, low=low, high=high, n=n)

    def mean_sized(self, column: str, low: float, high: float, n: int) -> Query:
        return self._metric("mean_sized", c=column, low=low, high=high, n=n)

    def variance_sized(self, column: str, low: float, high: float, n: int, ddof: int = 0) -> Query:
        return self._metric("variance_sized", c=column, low=low, high=high, n=n, ddof=ddof)

    def two_phase_count(
        self, coarse_keyset: DataFrame, fine_keyset: DataFrame, threshold: float, coarse_share: float = 0.1
    ) -> Query:
        """Coarse counts first, fine ones of the large groups after them; the fine keys hold the coarse ones."""
        return self._metric(
            "two_phase_count", coarse_keyset=coarse_keyset, coarse=coarse_keyset.columns,
            fine_keyset=fine_keyset, fine=fine_keyset.columns, threshold=threshold, coarse_share=coarse_share,
        )

    def _metric(self, name: str, **options: object) -> Query:
        return replace(self, metric=name, options=options)

    def rows(self, df: DataFrame, hidden: Sequence[str] = ()) -> DataFrame:
        """The view's rows after all steps."""
        for step in self.steps:
            df = step(df, hidden)
            if [c for c in df.columns if c.startswith(HIDDEN)] != list(hidden):
                raise UnsafeStep(f"a step uses a name that begins with {HIDDEN}")
        return df

    @property
    def influence(self) -> int:
        """How many rows one row of the view can become in the steps; counts public tables."""
        return math.prod(factor() for factor in self.factors)


def _spare(delta: float) -> float:
    if not 0 < delta < 1:
        raise ValueError(f"delta must lie between 0 and 1, got {delta}")
    return float(delta)


class PrivacySession:
    """Named private views and what may still be spent on them.

    The budget is an epsilon, or a rho with ``measure="zcdp"``; it may be infinite. With ``measure="approx"``
    it is an epsilon and a ``delta``, which pays for the deltas of queries and for ``slack``: the part given up so that
    many small epsilons compose to less than their sum. The amounts of such queries must not depend on answers.

    A query that does not fit raises before Spark is asked for anything. The spend is recorded before the job
    runs, so that a failed job is not free. With ``ledger_path`` it is also written to a table there, and a
    session of the same name begins with what has been spent. Several sessions of a name may be open at a time, in one
    program or in many: each charge is a file with a number that only one of them can get, and who does not get it
    reads what the others have spent and checks its own query against what is left. With ``resume=False`` the spends
    of other sessions of the name do not count.

    ``close`` removes the intermediate tables of a session, which hold exact private sums. Secure answers are
    tables of their own and stay; seeded answers are lazy and must have been read before.
    """

    def __init__(
        self,
        spark: SparkSession,
        views: Mapping[str, DataFrame],
        budget: float,
        *,
        measure: str = "pure",
        unit: PrivacyUnit = ROW,
        noise: Noise | None = None,
        name: str = "session",
        ledger_path: str | None = None,
        delta: float = 0.0,
        slack: float = 0.0,
        resume: bool = True,
    ) -> None:
        if not budget > 0:
            raise ValueError(f"privacy budget must be positive, got {budget}")
        if measure not in MEASURES:
            raise ValueError(f"unknown privacy measure: {measure}")
        if measure != "approx" and (delta or slack):
            raise ValueError(f"a {measure} session has neither delta nor slack")
        if not 0 <= slack <= delta < 1:
            raise ValueError(f"delta must lie in [0, 1) and hold the slack, got {delta} and {slack}")
        self.spark = spark
        self.delta = float(delta)
        self.slack = float(slack)
        self.name = name
        self.budget = budget
        self.measure = measure
        self.unit = unit
        self.noise = noise or SecureNoise()
        self.ledger_path = ledger_path
        self._views = {view: self._marked(df) for view, df in views.items()}
        self._influence = {view: 1 for view in views}
        self._spends: list[tuple] = []
        self._amounts: list[float] = []
        self._deltas: list[float] = []
        self._intermediate: list[str] = []
        self._resume = resume
        self._charges = Charges(spark, ledger_path, name) if ledger_path else None
        if ledger_path and resume:
            self._read_back()

    def _read_back(self) -> None:
        """Begin with the spends that the ledger holds under this session's name."""
        try:
            ledger = self.spark.read.schema(SPENDS).parquet(self.ledger_path)
        except AnalysisException as absent:
            if absent.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return
        own = ledger.filter(F.col("session") == self.name).select("*", F.col("_metadata.file_name").alias("file"))
        for *row, file in own.orderBy("ts", "query").collect():
            self._count(tuple(row))
            number = self._charges.number_of(file)
            if number is not None:
                self._charges.next = max(self._charges.next, number + 1)

    def _count(self, row: tuple) -> None:
        """Add a spend of the ledger to what is spent."""
        epsilon, delta, rho = row[4], row[5] or 0.0, row[6]
        amount = epsilon
        if self.measure == "zcdp":
            amount = rho if rho is not None else None if epsilon is None else epsilon * epsilon / 2.0
        if amount is None or (delta and self.measure != "approx"):
            raise ValueError(f"the ledger has a spend of {self.name} that a {self.measure} session cannot count: {row}")
        self._spends.append(row)
        self._amounts.append(amount)
        self._deltas.append(delta)

    def refresh(self) -> None:
        """Count what other sessions of this name have spent since it was last looked at."""
        while self._charges is not None and (rows := self._charges.read_next()) is not None:
            if self._resume:
                for row in rows:
                    self._count(row)

    def _marked(self, df: DataFrame) -> DataFrame:
        """The view with its hidden columns; a derived view has them already."""
        given = [c for c in (self.unit.column, *self.unit.row_key) if c is not None]
        names = [f"{HIDDEN}{i}" for i in range(len(given))]
        if set(names) <= set(df.columns):
            return df
        return df.withColumns({name: F.col(c) for name, c in zip(names, given)}) if given else df

    @property
    def _hidden(self) -> list[str]:
        return [f"{HIDDEN}{i}" for i in range((self.unit.column is not None) + len(self.unit.row_key))]

    @property
    def _hidden_unit(self) -> PrivacyUnit:
        """The unit by its hidden columns."""
        if self.unit.column is None:
            return replace(self.unit, row_key=tuple(self._hidden))
        return replace(self.unit, column=self._hidden[0], row_key=tuple(self._hidden[1:]))

    @classmethod
    def from_dataframe(cls, df: DataFrame, source: str, budget: float, **options) -> PrivacySession:
        return cls(df.sparkSession, {source: df}, budget, **options)

    def _total(self, amounts: Sequence[float]) -> float:
        return advanced_epsilon(amounts, self.slack)

    def _total_delta(self, deltas: Sequence[float]) -> float:
        return -math.expm1(math.log1p(-self.slack) + math.fsum(math.log1p(-d) for d in deltas))

    @property
    def spent(self) -> float:
        return self._total(self._amounts)

    @property
    def spent_delta(self) -> float:
        """Deltas of the queries and the slack, which is spent from the start."""
        return self._total_delta(self._deltas)

    @property
    def remaining_delta(self) -> float:
        return max(self.delta - self.spent_delta, 0.0)

    @property
    def remaining(self) -> float:
        return self.budget - self.spent

    def __len__(self) -> int:
        return len(self._spends)

    def spends(self) -> DataFrame:
        """This session's spends as a table."""
        return self.spark.createDataFrame(self._spends, SPENDS)

    def _require(self, amounts: Sequence[float], deltas: Sequence[float], what: str) -> None:
        for amount in amounts:
            if not amount > 0:
                raise ValueError(f"privacy budget must be positive, got {amount}")
        if self._total([*self._amounts, *amounts]) > self.budget * (1 + 1e-12):
            raise BudgetExceeded(f"{what} needs {math.fsum(amounts)}, but only {self.remaining} is left")
        if self._total_delta([*self._deltas, *deltas]) > self.delta * (1 + 1e-9):
            raise BudgetExceeded(f"{what} needs a delta of {math.fsum(deltas)}, but only {self.remaining_delta} is left")

    def _charge(self, amount: float, query: str, mechanism: str, partition: str = "all", delta: float = 0.0) -> None:
        self._charge_all([(amount, query, mechanism, partition, delta)])

    def _charge_all(self, spends: Sequence[tuple[float, str, str, str, float]]) -> None:
        """Pay for several queries at once: (amount, query, mechanism, partition, delta) of each, all or none."""
        now = datetime.now(timezone.utc)
        rows = []
        for amount, query, mechanism, partition, delta in spends:
            epsilon, rho = (None, float(amount)) if self.measure == "zcdp" else (float(amount), None)
            rows.append((self.name, partition, query, mechanism, epsilon, float(delta), rho, now))
        amounts, deltas = [float(s[0]) for s in spends], [float(s[4]) for s in spends]
        while True:
            self._require(amounts, deltas, ", ".join(s[1] for s in spends))
            if self._charges is None or self._charges.write(rows):
                break
            self.refresh()
        self._spends += rows
        self._amounts += amounts
        self._deltas += deltas

    def _check(self, name: str, query: Query) -> None:
        """Refuse what could not be answered, before it is paid for."""
        if query.metric is None:
            raise ValueError(f"query {name} has no statistic")
        for option in ("value", "what", "c"):
            if not isinstance(query.options.get(option, ""), str | None):
                raise UnsafeStep(f"query {name} must name a column, and compute it in a step")
        for axis in (*query.options.get("axes", ()), *filter(None, [query.options.get("axis")])):
            if not isinstance(axis.column, str):
                raise UnsafeStep(f"query {name} must name the columns of its axes, and compute them in a step")
        if query.view not in self._views:
            raise ValueError(f"there is no view {query.view}")
        if query.delta and self.measure != "approx":
            raise ValueError(f"query {name} costs a delta, which a {self.measure} session does not have")
        by_unit = bool(query.found) or query.metric in ("found_keys", "sparse_histogram", "privacy_id_count")
        if by_unit and self.unit.column is None:
            raise ValueError(f"query {name} needs a privacy unit column")
        if query.metric == "found_keys" and not query.found:
            raise ValueError(f"query {name} does not say whose keys it wants")
        if query.metric in UNGROUPED and (query.found or query.keyset is not None):
            raise ValueError(f"{query.metric} takes no groups")
        if query.metric == "quantiles" and query.found:
            raise ValueError("quantiles need public groups")
        if query.metric in SIZED and self.unit.column is not None:
            raise ValueError("sized statistics protect rows, not units with an id")
        gaussian = query.metric == "two_phase_count" or (
            query.metric == "vector_sum" and query.options["norm"] == "l2" and not query.delta
        )
        if gaussian and self.measure != "zcdp":
            raise ValueError(f"query {name} takes Gaussian noise, which an epsilon alone does not pay")

    def create_view(self, query: Query, name: str) -> None:
        """A derived private view; it remembers how many rows one source row can become.

        Only this session knows the view: private rows are not published under a name of the catalog.
        """
        if name in self._views:
            raise ValueError(f"there already is a view {name}")
        self._influence[name] = self._influence[query.view] * query.influence
        self._views[name] = query.rows(self._views[query.view], self._hidden)

    def evaluate(self, query: Query, budget: float) -> DataFrame:
        """Charge, then answer. Secure answers are computed now and written once."""
        return self.evaluate_all({"answer": query}, budget)["answer"]

    def evaluate_all(
        self, queries: Mapping[str, Query], budget: float, weights: Mapping[str, float] | None = None
    ) -> dict[str, DataFrame]:
        """Declare several queries first, share one budget among them by weight, then run them."""
        for name, query in queries.items():
            self._check(name, query)
        shares = split_total(budget, {name: (weights or {}).get(name, 1.0) for name in queries})
        self._charge_all([(shares[name], f"{q.metric}({q.view})", q.metric, "all", q.delta) for name, q in queries.items()])
        with noting_intermediates(self._intermediate):
            return {name: self._run(query, shares[name]) for name, query in queries.items()}

    def _run(self, query: Query, budget: float) -> DataFrame:
        unit = self._hidden_unit
        if unit.column is None:
            unit = replace(unit, rows=unit.rows * self._influence[query.view] * query.influence)
        df = query.rows(self._views[query.view], self._hidden)
        options, noise, zcdp = query.options, self.noise, self.measure == "zcdp"
        # a pure epsilon costs rho = epsilon^2 / 2
        epsilon = math.sqrt(2.0 * budget) if zcdp else budget
        groups = {"by": query.keyset.columns, "keyset": query.keyset} if query.keyset is not None else {}

        if query.metric == "two_phase_count":
            return two_phase_count(df, total_rho=budget, noise=noise, unit=unit, **options)
        if query.metric == "vector_sum":
            rho = budget if zcdp else approx_to_zcdp(budget, query.delta) if query.delta else None
            amount = epsilon if options["norm"] == "l1" else rho
            return dp_vector_sum(df, budget=amount, noise=noise, unit=unit, **options)
        if query.metric == "histogram":
            return histograms.dp_histogramdd(df, options["axes"], epsilon, noise, unit=unit)
        if query.metric == "sparse_histogram":
            return histograms.dp_sparse_histogram(df, options["axes"], unit, epsilon, query.delta, noise)
        if query.metric == "quantiles":
            return histograms.dp_quantiles(df, epsilon=epsilon, noise=noise, unit=unit, **groups, **options)
        if query.metric in SIZED:
            # a group of rows is protected by as many shares of the epsilon
            return SIZED[query.metric](df, epsilon=epsilon / unit.rows, noise=noise, **options)
        if query.metric == "found_keys":
            return private.select_partitions(df, unit, query.found, epsilon, query.delta, noise)
        if query.metric == "count" and zcdp:
            return private.dp_group_count(
                df, query.keyset, groups.get("by", []), budget, noise, measure="zcdp", unit=unit
            )
        if query.found:
            groups = {"by": query.found, "selection": (epsilon / 2.0, query.delta)}
            epsilon = epsilon / 2.0
        if query.metric == "count_nonzero":
            return private.dp_count_nonzero(df, options["what"], epsilon, noise, unit=unit, **groups)
        if query.metric == "aggregate":
            return private.dp_aggregate(df, epsilon=epsilon, noise=noise, unit=unit, **groups, **options)
        return private.dp_aggregate(df, [query.metric], epsilon, noise, unit=unit, **groups, **options)

    def close(self) -> None:
        """Remove the intermediate tables that this session has written."""
        while self._intermediate:
            remove(self.spark, self._intermediate[-1])
            self._intermediate.pop()

    def __enter__(self) -> PrivacySession:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def partition_and_spend(
        self, view: str, attribute: str, splits: Mapping[str, object], budget: float, delta: float = 0.0
    ) -> dict[str, PrivacySession]:
        """Disjoint child sessions by the value of one column; all of them together cost ``budget`` once.

        Children are paid for here, so they start anew and never with what an earlier child has spent.

        To answer the same question for every part, group one session by ``attribute`` instead: that is
        one job rather than one per child.
        """
        if len(set(splits.values())) != len(splits):
            raise ValueError("splits must name different values")
        df, unit = self._views[view], self._hidden_unit
        if unit.column is None:
            factor = min(unit.rows * self._influence[view], len(splits))
        else:
            factor = min(unit.partitions, len(splits))
            df = bound_partitions(df.filter(df[attribute].isin(list(splits.values()))), unit, [attribute])
        if delta and self.measure != "approx":
            raise ValueError(f"a {self.measure} session has no delta")
        self._charge_all([(budget * factor, f"partition({view})", "parallel", attribute, delta * factor)])
        children = {}
        for name, value in splits.items():
            part = df.filter(F.col(attribute) == F.lit(value))
            child = PrivacySession(
                self.spark, {view: part}, budget, measure=self.measure, unit=self.unit, noise=self.noise,
                name=f"{self.name}/{name}", ledger_path=self.ledger_path, delta=delta, resume=False,
            )
            child._intermediate = self._intermediate
            child._influence[view] = self._influence[view]
            children[name] = child
        return children
