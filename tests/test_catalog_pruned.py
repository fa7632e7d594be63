"""A catalog of paths classifies files only for those who ask for the class."""

from __future__ import annotations

from factloom.operators import files


def test_languages_cost_no_classification(spark):
    table = spark.createDataFrame([("r", "src/a.ts", "x"), ("r", "src/b.ts", "x"), ("r", "c.py", "x"), ("r", "node_modules/d.js", "x"), ("s", "LICENSE", "")], "repo_id string, path string, content string")
    cat = files.catalog(table, read=False)
    main = files.primary_language(cat)
    plan = main._jdf.queryExecution().optimizedPlan().toString()
    assert "file_class" not in plan and "explode" not in plan
    assert {tuple(r) for r in main.collect()} == {("r", "TypeScript"), ("s", "Unknown")}
    assert {r.path: r.file_class for r in cat.collect()} == {r.path: r.file_class for r in table.select("path", files.classify(table["path"], files.F.length("content")).alias("file_class")).collect() if "node_modules" not in r.path}
