"""All queries on empty tables, on rows that are null throughout, and on tables
with extra columns whose names the operators use inside."""

import os

import pytest
from pyspark.sql import functions as F

from marlstone.llm import queries

FIXED = {"tasks", "sample_targets", "split_targets", "common_words"}
EXTRA = ["tokens", "n", "rank", "id", "row", "bucket", "salt", "value", "g", "o", "t", "ids", "key", "_text", "_chunk", "kind", "entity", "record", "split", "stratum", "words", "text_hash"]


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    base = tmp_path_factory.mktemp("edge")
    made = {k: str(base / k) for k in ("empty", "nulls", "extra")}
    for name in sorted(n.split(".")[0] for n in os.listdir(sf)):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        none = df.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]).limit(1)
        fixed = name in FIXED
        (df if fixed else df.limit(0)).write.parquet(f"{made['empty']}/{name}.parquet")
        (df if fixed else df.unionByName(none).unionByName(none)).coalesce(1).write.parquet(f"{made['nulls']}/{name}.parquet")
        more = df.withColumns({c: F.lit("x") for c in EXTRA if c not in df.columns})
        more.coalesce(1).write.parquet(f"{made['extra']}/{name}.parquet")
    return made


def rows(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tables, name):
    got = queries.QUERIES[name](spark, tables["empty"])
    assert got.columns
    if not name.startswith("p3_"):  # its report has the target strata
        assert got.count() == 0


@pytest.mark.parametrize("name", [q for q in sorted(queries.QUERIES) if q.endswith(("_found", "_events"))])
def test_rows_of_nulls_change_nothing(spark, sf, tables, name):
    assert rows(queries.QUERIES[name](spark, tables["nulls"])) == rows(queries.QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"p7_ids", "p7_decoded"}))
def test_rows_of_nulls_run(spark, tables, name):
    assert queries.QUERIES[name](spark, tables["nulls"]).count() >= 0


@pytest.mark.parametrize("name", [q for q in sorted(queries.QUERIES) if q.endswith(("_found", "_ids", "_percentiles", "_splits"))])
def test_extra_columns_change_nothing(spark, sf, tables, name):
    assert rows(queries.QUERIES[name](spark, tables["extra"])) == rows(queries.QUERIES[name](spark, sf))
