"""Posts are compared by their whole texts."""

from tidewater.catalog import QUERIES


def test_repeats_are_those_of_whole_texts(spark, tmp_path):
    rows = [
        (1, "The same text of both"), (3, " the  same text of BOTH"),  # a copy, at another doc_id % 12
        (11, "alpha comes first"), (23, "all of it differs"),  # equal in their first letter, at doc_id % 12 = 11
        (5, "x" * 5000 + " a"), (7, "x" * 5000 + " b"),
    ]
    docs = spark.createDataFrame([(i, text, "en", "web", len(text)) for i, text in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.ordinal for r in QUERIES["flt_9_clean_posts"](spark, str(tmp_path)).collect()) == [1, 5, 7, 11, 23]
    heat = QUERIES["agg_28_heat"](spark, str(tmp_path)).collect()
    assert [(r.symbol, r.posts, r.authors) for r in heat] == [("en", 5, 1)]
