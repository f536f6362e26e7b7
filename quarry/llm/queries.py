"""Driver queries of the training-data operators: one per operator, and the pipeline."""

from __future__ import annotations

from quarry.llm import (bm25_wand, byte_cnn, duck_bpe, fill_middle, fst_tokens, hamming_minhash, license_scan,
                        line_winnow, maglev_shards, prefix_trie, seekable_warc, suffix_repetition, zstd_toxicity)


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    suffix_repetition.op1_suffix_repetition, line_winnow.op2_line_winnow, maglev_shards.op3_maglev_shards,
    zstd_toxicity.op4_zstd_toxicity, seekable_warc.op5_seekable_warc, duck_bpe.op6_duck_bpe,
    hamming_minhash.op7_hamming_minhash, fst_tokens.op8_fst_tokens, byte_cnn.op9_byte_cnn,
    bm25_wand.op10_bm25_wand, fill_middle.op11_fill_middle, prefix_trie.op12_prefix_trie,
    license_scan.op13_license_scan, pipeline)}

ORACLE = {
    "op1_suffix_repetition": suffix_repetition.ORACLE,
    "op5_seekable_warc": seekable_warc.ORACLE,
    "op7_hamming_minhash": hamming_minhash.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
