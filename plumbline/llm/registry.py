"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, html_text, mixing, ngram_join, packing, prefix_trie, ptolemaic, quality, secrets, toxicity, vector_packing, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_secrets": secrets.op4_secrets,
    "op5_html_text": html_text.op5_html_text,
    "op6_warc": warc.op6_warc,
    "op7_quality": quality.op7_quality,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_packing": packing.op9_packing,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_centroids": ptolemaic.op12_centroids,
    "op13_vector_packing": vector_packing.op13_vector_packing,
}
SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op6_warc": warc.OP6_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_centroids": ptolemaic.OP12_SQL,
}
