"""The whole reconciliation over the six settlement tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import batch_link, calendar, cases
from ledgerloom.plans import lens as L


class Engine:
    """Three outcome populations; every frame is lazy and built once."""

    def __init__(self, tables, days: DataFrame, rates: DataFrame, cycles: DataFrame, gst: str, as_of: str):
        """tables: ledger, payments, refunds, lines, batches and bank by name, each asked for when a query first needs it."""
        self._tables = tables
        #: Labels by name, where there are some: true_cases, true_links and true_rows.
        self.labels = None
        self.days, self.rates, self.cycles, self.gst, self.as_of = days, rates, cycles, gst, as_of

    @property
    def ledger(self) -> DataFrame:
        return self._tables["ledger"]

    @property
    def payments(self) -> DataFrame:
        return self._tables["payments"]

    @property
    def refunds(self) -> DataFrame:
        return self._tables["refunds"]

    @property
    def lines(self) -> DataFrame:
        return self._tables["lines"]

    @property
    def batches(self) -> DataFrame:
        return self._tables["batches"]

    @property
    def bank(self) -> DataFrame:
        return self._tables["bank"]

    @cached_property
    def credits(self) -> DataFrame:
        return batch_link.credits_of(self.bank)

    @cached_property
    def facts(self) -> DataFrame:
        return cases.case_facts(self.ledger, self.payments, self.refunds, self.lines, self.rates, self.gst)

    @cached_property
    def cases(self) -> DataFrame:
        return cases.case_outcomes(self.facts, self.ledger, self.days)

    @cached_property
    def profiles(self) -> DataFrame:
        return cases.batch_profiles(self.lines, self.payments, self.ledger)

    @cached_property
    def passes(self) -> batch_link.BatchPasses:
        return batch_link.BatchPasses(self.batches, self.bank, self.profiles, self.cycles, self.days, self.as_of)

    @cached_property
    def batch_links(self) -> DataFrame:
        return self.passes.outcomes()

    @cached_property
    def row_variances(self) -> DataFrame:
        return batch_link.row_variances(self.ledger, self.passes.orphan_credits())


_engines: dict[tuple[str, str], Engine] = {}


def over_lens(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over a folder's tables; a session has one, so the passes that it has written are used again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        _engines[key] = _over_lens(spark, sf_dir)
    return _engines[key]


def _over_lens(spark: SparkSession, sf_dir: str) -> Engine:
    views = L.Lens(spark, sf_dir)
    days = calendar.calendar(spark, L.FIRST_DAY, L.LAST_DAY, L.HOLIDAYS)
    engine = Engine(views, days, views["rates"], views["cycles"], L.GST, L.AS_OF)
    engine.labels = views
    return engine
