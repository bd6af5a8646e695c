"""Sequential admission: calls in order against budgets, where a refused call costs nothing and later ones may still go through.

The fold is the one thing here that has an order: what a call may cost depends on which calls before it went through. A
period (a month, a day) is folded as a stream of sorted rows that holds the sums alone, one number an agent, however many
rows the period has. Periods that stay within all budgets even if every call goes through aren't folded: partial sums
tell them, and their rows are all admitted where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

#: The state store that named states need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Budget:
    """What a period has spent, in all and by agent."""

    def __init__(self, spent: dict | None = None):
        self.spent = spent or {}

    def admits(self, agent: object, estimate: int, cost: int, own_cap: int | None, cap: int | None) -> bool:
        """Takes the call if its estimate fits what is left of both caps; a refused one leaves everything as it is.

        A call without an estimate, or of an agent or a period without a cap, is refused.
        """
        if estimate is None or own_cap is None or cap is None:
            return False
        own, total = self.spent.get(agent, 0), self.spent.get(None, 0)
        if estimate > min(own_cap - own, cap - total):
            return False
        cost = cost or 0
        self.spent[agent] = own + cost
        self.spent[None] = total + cost
        return True


def with_caps(calls: DataFrame, agent_caps: DataFrame, period_caps: DataFrame, period: str, agent: str) -> DataFrame:
    """calls with own_cap and cap from tables of one row an agent (agent, cap) and one a period (period, cap)."""
    own = agent_caps.select(F.col(agent), F.col("cap").cast("long").alias("own_cap"))
    return calls.join(own, agent, "left").join(period_caps.select(F.col(period), F.col("cap").cast("long").alias("cap")), period, "left")


def admission(calls: DataFrame, agent_caps: DataFrame, period_caps: DataFrame, period: str, agent: str, order: Sequence[str], estimate: str, cost: str) -> DataFrame:
    """calls with `admitted`: is the estimate within what is left of the agent's and the period's cap at its place in the order.

    estimate and cost are whole numbers (cents), neither below 0; an admitted call spends its cost. order must be total
    within a period; a null period is one like any other, without a cap. Repeated rows are calls of their own.
    """
    names = calls.columns
    capped = with_caps(calls, agent_caps, period_caps, period, agent)
    most = F.sum(F.greatest(F.coalesce(estimate, F.lit(0)), F.coalesce(cost, F.lit(0))))
    fits = F.coalesce(F.col("most") <= F.col("own_cap"), F.lit(False))
    by_agent = capped.groupBy(period, agent).agg(most.alias("most"), F.min("own_cap").alias("own_cap"), F.min("cap").alias("cap"), F.count_if(F.col(estimate).isNull()).alias("unknown"))
    by_period = by_agent.groupBy(period).agg((F.bool_and(fits) & (F.sum("most") <= F.min("cap")) & (F.sum("unknown") == 0)).alias("ample"))
    known = capped.join(by_period.where("ample"), period, "left")
    ample = known.where("ample").select(*names, F.lit(True).alias("admitted"))
    tight = known.where("ample IS NULL").drop("ample").repartition(period).sortWithinPartitions(period, *order)
    at = [tight.columns.index(c) for c in (period, agent, estimate, cost, "own_cap", "cap")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, budget = object(), Budget()
        for batch in batches:
            admitted = []
            for key, *call in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if key != last:
                    last, budget = key, Budget()
                admitted.append(budget.admits(*call))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(admitted, pa.bool_())], names=[*names, "admitted"])

    schema = StructType([*(tight.schema[c] for c in names), StructField("admitted", BooleanType(), True)])
    return ample.unionByName(tight.mapInArrow(fold, schema))


class _Admission(StatefulProcessor):
    """The same fold over micro-batches: a period's sums are its state."""

    def __init__(self, period: str, agent: str, order: Sequence[str], estimate: str, cost: str, names: Sequence[str]):
        self.period, self.agent, self.order, self.estimate, self.cost, self.names = period, agent, list(order), estimate, cost, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("spent", "agents array<string>, spent array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  the interface's name
        calls = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # a period's rows of one micro-batch
        held = self.sums.get() if self.sums.exists() else ([], [])
        budget = Budget(dict(zip(held[0], held[1], strict=True)))
        whole = lambda x: None if pd.isna(x) else int(x)
        calls["admitted"] = [budget.admits(a, whole(e), whole(c), whole(o), whole(p)) for a, e, c, o, p in zip(calls[self.agent], calls[self.estimate], calls[self.cost], calls["own_cap"], calls["cap"], strict=True)]
        self.sums.update((list(budget.spent), [int(v) for v in budget.spent.values()]))
        yield calls[[*self.names, "admitted"]]

    def close(self) -> None:
        pass


def admission_stream(calls: DataFrame, agent_caps: DataFrame, period_caps: DataFrame, period: str, agent: str, order: Sequence[str], estimate: str, cost: str) -> DataFrame:
    """`admission` of a stream: each micro-batch's calls in order, after those of the batches before.

    A call that comes in a later batch is later, whatever its time. Set spark.sql.streaming.stateStore.providerClass to
    STATE_STORE for the stream's session. Keeps one short row of sums a period in the state store.
    """
    capped = with_caps(calls, agent_caps, period_caps, period, agent)
    schema = StructType([*calls.schema.fields, StructField("admitted", BooleanType())])
    processor = _Admission(period, agent, order, estimate, cost, calls.columns)
    return capped.groupBy(period).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def gate(paused: Column, own_spent: Column, own_cap: Column, spent: Column, cap: Column) -> Column:
    """Why an agent may not start at all: paused, own cap reached, or the period's; else `go`."""
    return F.when(paused, "paused").when(F.coalesce(own_spent >= own_cap, F.lit(True)), "own cap").when(F.coalesce(spent >= cap, F.lit(True)), "total cap").otherwise("go")
