"""What the registered toxicity query and each stage of the pipeline return, against plain versions on whole tables."""

import os
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_operators import plain_lines
from test_shingle_dedup import plain_stay
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from loomshelf.llm import queries
from loomshelf.llm.common import settle
from loomshelf.llm.perplexity import judge

LARGER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="too few labels in the smallest tables")
def test_toxicity_of_documents_that_were_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in queries.QUERIES["op7_toxicity"](spark, LARGER).collect() if r.held_out and r.doc_id in labels]
    toxic, ordinary = [r for r in rows if r[2] == 1], [r for r in rows if r[2] == 0]
    assert toxic and len(ordinary) > 50
    assert np.mean([t[0] > o[0] for t in toxic for o in ordinary]) > 0.85  # area under the curve, from the 3,000 labels or so of these tables
    assert np.mean([o[1] == 0 for o in ordinary]) > 0.95 and all(r[1] == (r[0] >= 0.5) for r in rows)


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The rows before the first stage and after each, as (doc_id, text) and as they are."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], sf), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_quality_leaves_what_is_not_rejected(spark, sf, stages):
    kept = {r.doc_id for r in judge(stages[0], spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    before, after = texts(stages[0]), texts(stages[1])
    assert after == {i: t for i, t in before.items() if i in kept} and len(after) < len(before)


def test_line_dedup_leaves_first_lines(stages):
    before, after = texts(stages[1]), texts(stages[2])
    gone = {}
    for i, k, kept, *_ in plain_lines(list(before.items())):
        if not kept:
            gone.setdefault(i, set()).add(k)
    want = {}
    for i, t in before.items():
        left = t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        if i not in gone or re.search(r"[^\x20\x09-\x0D]", left):
            want[i] = left
    assert after == want and gone
    assert all(r.n_chars == len(r.text or "") for r in stages[2].collect())


def test_near_dedup_leaves_one_of_each_group(stages):
    before = texts(stages[2])
    stay, _ = plain_stay(sorted(before.items()))
    assert texts(stages[3]) == {i: before[i] for i in stay}


def test_documents_with_a_benchmark_item_go(spark, sf, stages):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(w := words(r.text)) >= 5]
    whole = {" ".join(w) for w in items}
    pieces = {" ".join(w[k : k + 2]) for w in items for k in range(len(w) - 1)}
    before, after = texts(stages[3]), texts(stages[4])
    assert set(after) < set(before) and all(after[i] == before[i] for i in after)
    for i, t in before.items():
        own = f" {' '.join(words(t))} "
        if any(f" {w} " in own for w in whole):
            assert i not in after
        elif i not in after:  # what goes shares at least some neighbouring words
            w = words(t)
            assert {" ".join(w[k : k + 2]) for k in range(len(w) - 1)} & pieces


def test_token_ids_are_those_of_the_library(stages):
    known = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    before = texts(stages[4])
    got = {r.doc_id: (np.frombuffer(r.token_ids, "<u4").tolist(), r.n_tokens) for r in stages[5].collect()}
    want = {i: known.encode_ordinary(t or "") for i, t in before.items()}
    assert got == {i: (ids, len(ids)) for i, ids in want.items()}
