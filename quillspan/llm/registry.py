"""Queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from quillspan.llm.decontaminate import op10_decontaminate
from quillspan.llm.fim import OP11_SQL, op11_fim
from quillspan.llm.html_density import op12_main_text
from quillspan.llm.licenses import op9_licenses
from quillspan.llm.merkle import OP13_SQL, op13_merkle
from quillspan.llm.mixing import OP8_SQL, op8_mixing
from quillspan.llm.pii import op1_pii
from quillspan.llm.quality_gbt import op4_quality_gbt
from quillspan.llm.quality_rules import op3_quality_rules
from quillspan.llm.sharding import op6_sharding
from quillspan.llm.simhash_dedup import op7_simhash_dedup
from quillspan.llm.suffix_dedup import op5_repeated_strings
from quillspan.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_gbt": op4_quality_gbt,
    "op5_repeated_strings": op5_repeated_strings,
    "op6_sharding": op6_sharding,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_mixing": op8_mixing,
    "op9_licenses": op9_licenses,
    "op10_decontaminate": op10_decontaminate,
    "op11_fim": op11_fim,
    "op12_main_text": op12_main_text,
    "op13_merkle": op13_merkle,
}

ORACLES = {"op2_warc": OP2_SQL, "op8_mixing": OP8_SQL, "op11_fim": OP11_SQL, "op13_merkle": OP13_SQL}
