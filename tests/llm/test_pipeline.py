import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from boardstat.llm import quality
from boardstat.llm.queries import TOKENIZER
from boardstat.llm.tokens import encode_whole

from .fixtures import components, documents
from .test_decontaminate import words
from .test_packing import check
from .test_simhash import fingerprint

SF = "/root/testdata/sf0.001"


def holds_passage(text, items):
    """Whether 11 of 13 aligned words are equal somewhere; diagonals are those of equal words."""
    w = words(text)
    for t in items:
        places = defaultdict(list)
        for q, x in enumerate(t):
            places[x].append(q)
        for diagonal in {p - q for p, x in enumerate(w) for q in places.get(x, ())}:
            equal = [0 <= diagonal + q < len(w) and w[diagonal + q] == x for q, x in enumerate(t)]
            if any(sum(equal[s:s + 13]) >= 11 and 0 <= diagonal + s and diagonal + s + 13 <= len(w) for s in range(len(t) - 12)):
                return True
    return False


def test_whole_pipeline_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scores = quality.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = sorted(r["doc_id"] for r in scores.collect() if r["score"] >= 0.3)
    prints = {i: fingerprint(docs[i]) for i in good}
    roots = components(good, [(a, b) for a in good for b in good if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    clean = [i for i in good if roots[i] == i and not holds_passage(docs[i], items)]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert check(rows, 2048) and sorted({r["doc_id"] for r in rows}) == clean
    for r in rows:
        ids = encode_whole(TOKENIZER, [docs[r["doc_id"]]])[0] + [0]
        part = ids[r["start"]:r["start"] + 2048]
        assert (len(part), zlib.crc32(np.array(part, "<u4").tobytes())) == (r["length"], r["ids_crc32"])
    assert len(rows) == sum(-(-(len(encode_whole(TOKENIZER, [docs[i]])[0]) + 1) // 2048) for i in clean)


def test_stages_take_odd_and_empty_documents(spark):
    for docs in (documents(spark), documents(spark, [])):
        for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            n = out.count()
            if place + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns and n <= docs.count()
                docs = out
