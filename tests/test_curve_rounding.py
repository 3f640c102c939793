"""Scores that end on a tie in the digit that is cut: the curve agrees with its SQL."""

import duckdb

import __spark_entry__ as entry


def test_curve_of_scores_on_ties(spark, tmp_path):
    n = list(range(4, 9000, 8))  # n / 8000 ends on a 5 in the fourth digit
    docs = [(i, f"t{i}", "en", "s", x) for i, x in enumerate(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(len(n))], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["eval_curve"]).fetchall()
    got = [tuple(r) for r in entry.queries()["eval_curve"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) > 900
