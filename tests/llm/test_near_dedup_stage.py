"""The pipeline's near-dedup stage compares fingerprints."""

import corpus_pipeline
from threadweave.llm.simhash import fingerprints


def test_stage_links_by_fingerprint_bits(spark):
    text = " ".join(f"word{k} is here" for k in range(60))
    texts = [text] + [text + f" tail{k}" for k in range(12)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    prints = [int(f) for f in fingerprints(texts)]
    group = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if (prints[a] ^ prints[b]).bit_count() <= corpus_pipeline.NEAR_BITS:
                    group[a] = group[b] = min(group[a], group[b])
    assert kept == {k for k, g in enumerate(group) if k == g}
