import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
ODD = [
    (900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "one"), (900_005, "One"), (900_006, LONG), (900_007, LONG + " tail"),
    (900_008, BASE), (900_009, BASE), (900_010, BASE.replace("alpha3 ", "gamma ")), (900_011, BASE[:400]), (900_012, "Ünï çödé — 文字 \U0001f600 " * 9),
    (900_013, "a b\nc d\n\n c d\nc d\na b"), (900_014, "it's we'll they've  x \r\n\x0b y z '' 's 1234 $5.00!!"), (900_015, "<|endoftext|> <b>x</b> &amp;"),
    (900_016, "DON'T SHOUT!! " * 30), (900_017, "a" * 5000),
]


@pytest.fixture(scope="session")
def docs(spark, sf):
    """The small documents and odd ones, with columns whose names clash with those that operators add."""
    from pyspark.sql import functions as F

    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("odd"), "n_chars": F.length("text").cast("long")})
    both = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd)
    return both.withColumns({"node": F.lit("x"), "part": F.lit(1), "n_words": F.lit("y"), "tag": F.lit(2.0), "score": F.lit("z"), "spans": F.lit(3), "bucket": F.lit(4), "key": F.lit(5)}).repartition(3)


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
