"""The operators' queries and their reference SQL."""

from __future__ import annotations

import corpus_pipeline
from pagemill.llm import collocations, decontaminate, licenses, lines, mixing, quality, secrets, sharding, simhash, spelling, substrings, suffixes, vectors

QUERIES = {
    "op1_shard": sharding.op1_shard,
    "op2_quality": quality.op2_quality,
    "op3_simhash": simhash.op3_simhash,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_near_vectors": vectors.op6_near_vectors,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_secret_scan": secrets.op12_secret_scan,
    "op13_collocations": collocations.op13_collocations,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op6_near_vectors": vectors.OP6_SQL,
    "op8_substring_dedup": substrings.OP8_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
