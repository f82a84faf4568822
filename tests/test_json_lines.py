"""Documents written as JSON lines come back each with its own id and language, however their tasks lie."""

from corpusloom.plans import catalogue, measures  # noqa: F401  (registers the query)


def test_equal_texts_of_a_source_keep_their_languages(spark, tmp_path):
    docs = [(i, "la même" if i % 2 else "", ("fr", "es", "de")[i % 3], "src1", 7) for i in range(60)] + [(60, None, "en", "src1", 0), (61, "x", None, None, 1), (62, 'a "b"\r\n\\c', "en", "src2", 9)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    # the first file holds the last rows, and each is read by a task of its own
    table.repartitionByRange(6, -table["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        got = catalogue.QUERIES["json_lines"](spark, str(tmp_path)).select("pos", "file", "text", "lang").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, got)) == [(i, source, text, lang) for i, text, lang, source, _ in docs]
