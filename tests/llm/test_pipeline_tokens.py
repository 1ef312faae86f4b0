"""The pipeline's product can be trained from: each document's token ids are rebuilt from run()'s rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.fixtures import documents, labels


def test_ids_of_every_document(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
    want = Counter()
    for r in now.select("doc_id", "text").collect():
        want[r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2])] += 1
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length
        pieces[r.doc_id].append((r.start, r.doc_tokens, tuple(ids.tolist())))
    got = Counter()
    for doc, own in pieces.items():
        starts = defaultdict(list)
        for start, tokens, ids in own:
            starts[start].append(ids)
        copies = len(starts[0])
        assert all(len(x) == copies and len(set(x)) == 1 for x in starts.values())      # copies of one text
        got[doc, sum((starts[s][0] for s in sorted(starts)), ())] = copies
    assert got == want
    sequences = defaultdict(dict)
    for r in rows:
        sequences[r.sequence_id][r.offset] = r.length
    for own in sequences.values():
        ends = np.cumsum([own[o] for o in sorted(own)])
        assert sorted(own) == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
