"""The pipeline over a small folder of tables, against what each stage must keep."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from copytrail.llm.common import table
from tests.llm.test_operators import DOCS, prose

NOTICE = "Sign up for the weekly letter and never miss a story"
ITEM = prose(4001, 30)


def text_of(k):
    lines = [prose(1000 + 3 * k + j, 25) for j in range(3)]
    return "\n".join([*lines[:2], NOTICE, lines[2]] if k < 20 else lines)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    bad = [" ".join(w + random.Random(k).choice(["###", "$$$", "%%%"]) for w in prose(k, 60).split()) for k in range(60)]
    near = [" ".join("other" if i == 30 else w for i, w in enumerate(text_of(k).split(" "))) for k in range(30, 36)]
    leaks = [f"{prose(3000 + k, 20)}\n{ITEM.upper()}\n{prose(3100 + k, 20)}" for k in range(5)]
    texts = [*map(text_of, range(120)), *bad, *near, *[text_of(40)] * 3, *leaks]
    root = str(tmp_path_factory.mktemp("small"))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_pipeline_keeps_clean_documents_and_their_ids(spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(got) == list(range(120))
    for k, row in got.items():
        ids = library.encode("\n".join(line for line in text_of(k).split("\n") if line != NOTICE))
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = table(spark, folder, "documents")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(3), folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).collect() == []
