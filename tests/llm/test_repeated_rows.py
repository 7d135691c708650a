"""The SQL of the registered queries against the code on tables with repeated rows."""

import duckdb
import numpy as np

from pulsegrid.llm import queries


def both(spark, tmp_path, name, table, df):
    df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet/*.parquet'")
    out = queries.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, out.collect())), sorted(want)


def test_topk_of_repeated_queries_and_candidates(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=6).tolist()) for i in [*range(60), 20, 21, 21, 40]]
    rows += rows[20:22] * 2 + [(60, None), (80, [float("nan")] * 6)]
    got, want = both(spark, tmp_path, "op9_topk", "embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got == want and len(got) == 3 * 20


def test_line_runs_of_repeated_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    line = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))
    shared = [line(9) for _ in range(8)]
    rows = [(i, "\n".join([line(5), *shared, line(6)] if i % 2 else [line(5), line(7)])) for i in range(12)]
    rows += rows[3:6] + rows[3:4]
    got, want = both(spark, tmp_path, "op1_linededup", "documents", spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == want and sum(r[3] > 0 for r in got) == 8
