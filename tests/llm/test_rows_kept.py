"""What the filtering stages keep: rows by id and text, user columns with clashing and dotted names."""

from pyspark.sql import functions as F

from factloom.llm import line_dedup, ngram_join

A = "one two three four five six seven eight nine ten eleven twelve"
B = "quite another text with words that nobody else has ever put together here"


def test_a_different_text_under_the_id_of_a_copy_stays(spark):
    rows = [(1, A, "x"), (2, A, "y"), (2, B, "z"), (3, A + " thirteen", "near"), (4, "", "e"), (4, None, "n"), (None, A, "no id"), (5, B, "b"), (5, B, "b again")]
    table = spark.createDataFrame(rows, "doc_id long, text string, hash string").repartition(3)
    kept = ngram_join.one_of_each(table)
    assert kept.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, A), (2, B), (4, ""), (4, None), (None, A)], key=str)
    repeats = spark.createDataFrame([(1, A, "x")] * 3 + [(2, B, "y")], table.schema)
    assert sorted(r.doc_id for r in ngram_join.one_of_each(repeats).collect()) == [1, 2]
    assert ngram_join.one_of_each(table.limit(0)).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["gone", "gone_id", "gone_hash", "n_lines", "n_removed", "row", "id", "old", "hash", "a.b", "class"]
    table = spark.createDataFrame([(1, A + "\n" + B), (2, A), (3, "a sentence of the third text alone"), (4, B + "\nunlike any other line of these texts")], "doc_id long, text string")
    wide = table.select("doc_id", "text", *[F.concat(F.lit(n + "-"), F.col("doc_id").cast("string")).alias(n) for n in names])
    kept = line_dedup.drop_repeated_lines(wide, short_lines=True)
    assert kept.columns == wide.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert sorted(rows) == [1, 3, 4] and rows[4].text == "unlike any other line of these texts"
    assert all(r[n] == f"{n}-{i}" for i, r in rows.items() for n in names)
    out = line_dedup.dedup_lines(wide, short_lines=True)
    assert set(out.columns) == set(wide.columns) and {r.doc_id: r.n_removed for r in out.collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
