"""The queries of this subpackage and their SQL."""

from . import bpe, chat_format, decontaminate, elkan, hilbert, html_extract, jaccard, kneser_ney, line_dedup, minhash, repetition, toxicity

QUERIES = {
    "op1_crf_html": html_extract.query,
    "op2_line_dedup": line_dedup.query,
    "op3_toxicity": toxicity.query,
    "op4_decontaminate": decontaminate.query,
    "op5_jaccard_join": jaccard.query,
    "op6_hilbert_shards": hilbert.query,
    "op7_chat_format": chat_format.query,
    "op8_repetition": repetition.query,
    "op9_bpe": bpe.query,
    "op10_kneser_ney": kneser_ney.query,
    "op11_elkan_codes": elkan.query,
    "op12_minhash": minhash.query,
}

#: The others have no SQL: they are tested against brute force.
ORACLE_SQL = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op5_jaccard_join": jaccard.ORACLE,
    "op7_chat_format": chat_format.ORACLE,
    "op8_repetition": repetition.ORACLE,
    "op11_elkan_codes": elkan.ORACLE,
    "op12_minhash": minhash.ORACLE,
}
