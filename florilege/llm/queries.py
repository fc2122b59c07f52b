"""The queries of this subpackage, by name, with the SQL that checks them where SQL can."""

from __future__ import annotations

from florilege.llm.conversation_repair import op12_conversation_repair
from florilege.llm.decontamination import OP5_SQL, op5_decontamination
from florilege.llm.html_extraction import op4_html_extraction
from florilege.llm.jaccard_join import op2_jaccard_join
from florilege.llm.language_id import op3_language_id
from florilege.llm.line_dedup import op7_line_dedup
from florilege.llm.mixing import OP9_SQL, op9_mixing
from florilege.llm.nearest import op10_nearest
from florilege.llm.packing import op11_packing
from florilege.llm.periodic_runs import op13_periodic_runs
from florilege.llm.secret_scans import OP1_SQL, op1_secret_scans
from florilege.llm.sharding import op6_sharding
from florilege.llm.url_filters import OP8_SQL, op8_url_filters

QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_html_extraction": op4_html_extraction,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_nearest": op10_nearest,
    "op11_packing": op11_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op1_secret_scans": OP1_SQL,
    "op5_decontamination": OP5_SQL,
    "op8_url_filters": OP8_SQL,
    "op9_mixing": OP9_SQL,
}
