"""The queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

from docspark.llm import bag_minhash, chat_format, decontaminate, fill_in_middle, line_quality, mixing, prefix_trie, quality_qda, secret_scan, shard, token_counts, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_quality": line_quality.op4_line_quality,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_histogram_sort": shard.op7_histogram_sort,
    "op8_curriculum": mixing.op8_curriculum,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_bag_minhash": bag_minhash.op10_bag_minhash,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_quality_qda": quality_qda.op13_quality_qda,
}

ORACLE_SQL = {
    "op1_warc": warc.ORACLE,
    "op4_line_quality": line_quality.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op7_histogram_sort": shard.ORACLE,
    "op8_curriculum": mixing.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
