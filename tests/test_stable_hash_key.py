from trailmill.registry import QUERIES


def test_every_row_and_the_whole_key(spark, tmp_path):
    ids = [1, 12, 123456789012345678, 123456789012345679]
    spark.createDataFrame([(i, t) for i, t in zip(ids, ["a" * 60, "", None, "a" * 60 + "b"])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def slow(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c)) % 2**32
        return h

    texts = dict(zip(ids, ["a" * 60, "", "", "a" * 60 + "b"]))
    assert {r.doc_id: r.h for r in QUERIES["stable_hash"](spark, str(tmp_path)).collect()} == {i: slow(t) for i, t in texts.items()}
    assert {r.doc_id: r.h for r in QUERIES["stable_hash_key"](spark, str(tmp_path)).collect()} == {i: slow(str(i)) for i in ids}
