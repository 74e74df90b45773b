"""Running sums and predecessors in groups of any size.

Rows are range-partitioned by group and order into chunks (adaptive execution sizes
them by their bytes), so a group may span many tasks. What a chunk needs from the
ones before it is one row per chunk and group. Input columns may have any names; a
new column replaces one of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import stored


class Chunks:
    """`df` in order, written once; columns of it are read as `row.<name>`, those
    added here as `x.<name>`. Several steps go over the same chunks."""

    def __init__(self, df: DataFrame, group: list[str], order: list[str]) -> None:
        self.g, self.o = [f"g{i}" for i in range(len(group))], [f"o{i}" for i in range(len(order))]
        self.names, self.added = df.columns, []
        flat = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip([*group, *order], [*self.g, *self.o], strict=True)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
        self.df = stored(flat.repartitionByRange(*self.g, *self.o).withColumn("chunk", F.spark_partition_id()), "chunks").withColumn("x", F.struct(F.lit(None).cast("int").alias("_")))

    def _carried(self, carry: DataFrame) -> DataFrame:
        """The rows with `carry` (g.., chunk, carried)."""
        named = carry.withColumnsRenamed({c: f"c{c}" for c in [*self.g, "chunk"]})
        return self.df.join(named, [F.col(c).eqNullSafe(F.col(f"c{c}")) for c in self.g] + [F.col("chunk") == F.col("cchunk")]).drop(*[f"c{c}" for c in [*self.g, "chunk"]])

    def _add(self, df: DataFrame, values: dict[str, Column]) -> Chunks:
        self.df = df.withColumn("x", F.struct(*[F.col(f"x.`{n}`").alias(n) for n in self.added], *[v.alias(n) for n, v in values.items()])).drop("carried")
        self.added += list(values)
        return self

    def previous(self, value: Column, name: str) -> Chunks:
        """`value` of the row before in the group, null for the first."""
        v = F.struct(value.alias("v"))
        self.df = self.df.withColumn("own", F.lag(v).over(Window.partitionBy(*self.g, "chunk").orderBy(*self.o)))
        last = self.df.groupBy(*self.g, "chunk").agg(F.max_by(v, F.struct(*self.o)).alias("last"))
        carry = last.select(*self.g, "chunk", F.lag("last").over(Window.partitionBy(*self.g).orderBy("chunk")).alias("carried"))
        return self._add(self._carried(carry), {name: F.coalesce("own", "carried")["v"]})

    def sums(self, **values: Column) -> Chunks:
        """Sum of each value over the rows of the group up to this one."""
        inner = Window.partitionBy(*self.g, "chunk").orderBy(*self.o).rowsBetween(Window.unboundedPreceding, 0)
        across = Window.partitionBy(*self.g).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        self.df = self.df.withColumn("own", F.struct(*[v.alias(n) for n, v in values.items()]))
        totals = self.df.groupBy(*self.g, "chunk").agg(*[F.sum(f"own.`{n}`").alias(f"t{i}") for i, n in enumerate(values)])
        carry = totals.select(*self.g, "chunk", F.struct(*[F.coalesce(F.sum(f"t{i}").over(across), F.lit(0)).alias(n) for i, n in enumerate(values)]).alias("carried"))
        return self._add(self._carried(carry), {n: F.sum(f"own.`{n}`").over(inner) + F.col(f"carried.`{n}`") for n in values})

    def rows(self) -> DataFrame:
        """The input with the added columns."""
        return self.df.select(*[F.col(f"row.`{n}`").alias(n) for n in self.names if n not in self.added], *[F.col(f"x.`{n}`").alias(n) for n in self.added])


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` over the rows of `group` up to this one."""
    return Chunks(df, group, order).sums(**{name: F.col(f"row.`{value}`")}).rows()


def with_previous(df: DataFrame, group: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """`df` with `column` of the row before in `group`, null for the first."""
    return Chunks(df, group, order).previous(F.col(f"row.`{column}`"), name).rows()
