"""The pipeline against its stages done plainly, one row at a time."""
import hashlib
import re
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from narralytics.llm import mixing, pii, quality
from narralytics.llm.common import table
from tests.llm.helpers import awkward, empty
from tests.llm.test_near_duplicates import expected_groups, plain_fingerprint
from tests.llm.test_texts import plain_base


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {re.match(r"op\d+_|", n)[0] for n in names} and "pipeline" in names
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_stage", "simhash_stage", "pii_stage", "mixing_stage", "bpe_stage"]


def test_pipeline_against_plain_stages(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    left = {d.doc_id: d for d in docs.collect() if d.doc_id in good}
    groups = expected_groups(list(left), [plain_fingerprint(d.text) for d in left.values()])
    left = {i: d for i, d in left.items() if groups[i] == i}
    clean = {}
    for i, d in left.items():
        out, at = "", 0
        for start, _, finish, kind in plain_base(d.text):
            if start >= at:
                out += d.text[at:start] + f"[{kind.upper()}]"
            at = max(at, finish)
        clean[i] = out + d.text[at:]
    redacted = corpus_pipeline.simhash_stage(spark, corpus_pipeline.quality_stage(spark, docs, sf_dir), sf_dir)
    stage = {r.doc_id: r.text for r in corpus_pipeline.pii_stage(spark, redacted, sf_dir).collect()}
    added = {r.doc_id for r in pii.detect(redacted).where("size(pii_added) > 0").collect()}
    assert set(stage) == set(clean) and all(stage[i] == clean[i] for i in clean if i not in added)
    rows = spark.createDataFrame([(i, stage[i], left[i].lang, left[i].source, len(stage[i])) for i in left], docs.schema)
    kept = {r.doc_id for r in mixing.mix(rows).collect() if r.kept}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == kept
    for i in kept:
        ids = tokenizer.encode(stage[i], add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())


@pytest.mark.parametrize("make", [awkward, empty])
def test_stages_stand_awkward_tables(spark, sf_dir, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == corpus_pipeline.COLUMNS
        out.collect()
    corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
