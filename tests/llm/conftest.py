import pytest

CLASHING = ["score", "fp", "name", "row", "bucket", "rid", "turn", "start", "shard", "slot", "key", "at", "own", "length", "bytes", "base", "spans"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of{i % 61}" for i in range(15_000))


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table of documents from texts or (doc_id, text[, source]) rows; every name that is used inside clashes."""

    def make(rows, clash=True):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(data, COLUMNS).repartition(3)
        return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING]) if clash else df

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, null ids, white space only, repeated rows and ids, ties, special strings, a very long text."""
    return [
        (1, None, "src1"),
        (2, "", None),
        (None, "no id here, but a text of some words", "src2"),
        (None, None, None),
        (3, " \n\t  ", ""),
        (4, "the same row twice, word for word", "src1"),
        (4, "the same row twice, word for word", "src1"),
        (5, "the same row twice, word for word", "src1"),
        (5, "another text under the id five", "src3"),
        (6, "<|endoftext|> <s> </s> ▁▁ tab\there  two spaces   three \n\n end ", "src1"),
        (7, "Größe ﬁne ＡＢ 日本語のテキスト 😀😀 naïve x\x00y\x85z", "src0"),
        (8, LONG, "src0"),
        (9, "x" * 70_000, "src0"),
        (10, "a", "src0"),
    ]
