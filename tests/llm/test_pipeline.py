from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from spanlake.llm import common, language_id, mixing, quality_rules, simhash

from .helpers import odd_docs
from .test_simhash import brute_components, wide_print


def test_each_stage_does_its_work(spark, tiny):
    docs = common.table(spark, tiny, "documents")
    labels = common.table(spark, tiny, "labels")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_rules", "simhash_near_dedup", "mix_sources", "bpe_encode"]

    known = common.materialize(stages["language_id"](spark, docs, tiny))
    model = language_id.fit(docs)
    want = {r["doc_id"] for r in language_id.predict(docs, model).filter("NOT rejected").collect()}
    assert known.columns == docs.columns and {r["doc_id"] for r in known.collect()} == want and len(want) > 0.98 * docs.count()

    good = common.materialize(stages["quality_rules"](spark, known, tiny))
    want = {r["doc_id"] for r in quality_rules.apply_rules(known, labels).filter("kept").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == want and 0 < len(want) < known.count()

    single = common.materialize(stages["simhash_near_dedup"](spark, good, tiny))
    rows = good.select("doc_id", "text").collect()
    ids = [r["doc_id"] for r in rows]
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) == sorted(set(brute_components(ids, [wide_print(r["text"]) for r in rows], 24)))

    mixed = common.materialize(stages["mix_sources"](spark, single, tiny))
    want = Counter(r["doc_id"] for r in mixing.mix(single).collect() for d in r["draws"] if 2 * d["words"] >= r["size"])
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == want

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = Counter((r["doc_id"], r["n_tokens"]) for r in stages["bpe_encode"](spark, mixed, tiny).collect())
    assert got == Counter((r["doc_id"], len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in mixed.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, tiny).collect()) == got


def test_stages_take_odd_and_empty_tables(spark, tiny):
    for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = common.materialize(stage(spark, docs, tiny))
            if name != "bpe_encode":
                assert out.columns == docs.columns
            docs = out


def test_one_document_of_a_group_stays(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (9, "something else altogether here now")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [3, 9]
