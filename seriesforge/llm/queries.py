"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from seriesforge.llm import filter_audit, line_dedup, phrases
from seriesforge.llm.bpe import op9_bpe
from seriesforge.llm.context_tree import op11_context_tree
from seriesforge.llm.decontaminate import op5_decontaminate
from seriesforge.llm.filter_audit import op12_filter_audit
from seriesforge.llm.html_text import op10_html_text
from seriesforge.llm.line_dedup import op8_line_dedup
from seriesforge.llm.media import op2_media_telephony
from seriesforge.llm.phrases import op13_collocations
from seriesforge.llm.simhash import op4_simhash
from seriesforge.llm.suffix_dedup import op7_suffix_dedup
from seriesforge.llm.token_counts import op1_token_rollup
from seriesforge.llm.toxicity import op6_toxicity
from seriesforge.llm.unit_dedup import op3_unit_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_rollup, op2_media_telephony, op3_unit_dedup, op4_simhash, op5_decontaminate,
        op6_toxicity, op7_suffix_dedup, op8_line_dedup, op9_bpe, op10_html_text,
        op11_context_tree, op12_filter_audit, op13_collocations,
    )
}
ORACLE = {"op8_line_dedup": line_dedup.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_collocations": phrases.ORACLE_SQL}
