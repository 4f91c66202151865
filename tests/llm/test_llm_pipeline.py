"""The pipeline against its stages written down plainly."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, language, repeats
from tests.llm.test_llm_operators import brute_components, brute_repeats


def test_pipeline_equals_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    rows = docs.select("doc_id", "text").collect()
    labels, scores = language.train(docs).predict([r["text"] for r in rows])
    left = [(r["doc_id"], r["text"]) for r, x, s in zip(rows, labels, scores, strict=True) if x != "und" and s >= corpus_pipeline.LEAST_SCORE]
    clean = brute_repeats([x for _, x in left], repeats.line_rule())
    left = [(i, x) for (i, _), (x, _, gone) in zip(left, clean, strict=True) if not gone or x.strip(" ")]
    roots = brute_components([x for _, x in left])
    left = [p for n, (p, (_, root)) in enumerate(zip(left, roots, strict=True)) if root == n]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = decontaminate.brute([x for _, x in left], items)
    left = [p for p, b in zip(left, bad, strict=True) if not b[-1]]
    assert set(found) == {i for i, _ in left} and 0 < len(left) < len(rows)
    for i, text in left:
        data = np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    rows = [(1, None, "en", "s", None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "words of a text", "en", "s", 15), (3, "words of a text", "fr", "s", 15), (3, "words of a text", "fr", "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline._near_dedup(spark, docs, sf_dir).where("text = 'words of a text'").count() == 1
    assert corpus_pipeline._bpe(spark, docs, sf_dir).count() == len(rows)


def test_stages_take_columns_of_any_name(spark, sf_dir):
    """Names that operators use for their own columns, on every stage."""
    extra = ["score", "lang_pred", "n_words", "n_hit", "n_removed", "n_units", "contaminated", "row", "runs", "id", "tk", "t", "key", "kept", "component", "ids", "n_tokens", "h"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        rows = found.select(*extra).distinct().collect()
        assert found.columns == docs.columns and [tuple(r) for r in rows] == [tuple(range(len(extra)))]
    last = corpus_pipeline._bpe(spark, docs, sf_dir)
    assert set(extra) - set(last.columns) == set() and {"doc_ids", "doc_n_tokens", "ids", "n_tokens", "lang"} <= set(last.columns)
    assert last.select("doc_ids", "h").distinct().collect()[0] == (extra.index("ids"), extra.index("h"))
