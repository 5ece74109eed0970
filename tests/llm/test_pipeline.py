import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from murkwater.llm import langid, quality
from pyspark.sql import functions as F

from .test_bpe import check_pieces
from .test_jaccard import brute as classes
from .test_substring import brute as spans


def test_stages_equal_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "near_duplicates", "substring_dedup", "pack"]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        after[name] = docs
        if name != "pack":
            assert docs.columns == corpus_pipeline.COLUMNS
    got = {name: {r.doc_id: r.text for r in after[name].collect()} for name in names[:-1]}
    first = {r.doc_id for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("kept").collect()}
    assert got["quality_rules"] == {i: texts[i] for i in first}
    model = langid.fit(after["quality_rules"])
    second = {r.doc_id for r in langid.identify(after["quality_rules"], model).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert got["language_id"] == {i: texts[i] for i in second}
    component = classes(got["language_id"])
    assert got["near_duplicates"] == {i: texts[i] for i, (_, c) in component.items() if c == i}
    cut = {i: (t if gone else texts[i]) for i, n, gone, t in spans(got["near_duplicates"].items()) if n > gone}
    assert got["substring_dedup"] == cut
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in cut.items()}
    assert check_pieces(after["pack"].collect(), want) == 0


def test_run_and_odd_rows(spark, sf, docs):
    assert corpus_pipeline.run(spark, sf).count() > 0
    whole = docs.select(corpus_pipeline.COLUMNS).unionByName(docs.select(corpus_pipeline.COLUMNS).limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    for table in (whole, whole.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.written(stage(spark, now, sf), name)
        assert now.columns[:4] == ["doc_id", "start", "length", "tokens"]


def test_without_labels_documents_with_letters_stay(spark, sf):
    rows = [(1, "some words", None), (2, "12 34", None), (3, "слова", None), (4, None, None), (5, "字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("x"), "n_chars": F.lit(1).cast("long")})
    out = corpus_pipeline.language_id(spark, docs, sf)
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 5]
