"""The corpus operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import OP1_SQL, op1_benchmark_decontamination
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .language import op5_language_id
from .mixing import op8_source_mixing
from .pitman_yor import op11_pitman_yor
from .ranked_search import OP12_SQL, op12_ranked_search
from .secrets import OP9_SQL, op9_secret_scan
from .simhash_dedup import op2_simhash_near_dedup
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .suffix_dedup import op6_suffix_dedup
from .toxicity import op4_toxicity
from .warc import OP10_SQL, op10_warc_revisits


def queries() -> dict:
    return {
        "op1_benchmark_decontamination": op1_benchmark_decontamination,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_language_id": op5_language_id,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_source_mixing": op8_source_mixing,
        "op9_secret_scan": op9_secret_scan,
        "op10_warc_revisits": op10_warc_revisits,
        "op11_pitman_yor": op11_pitman_yor,
        "op12_ranked_search": op12_ranked_search,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": OP1_SQL,
        "op3_substring_dedup": OP3_SQL,
        "op7_exact_dedup": OP7_SQL,
        "op9_secret_scan": OP9_SQL,
        "op10_warc_revisits": OP10_SQL,
        "op12_ranked_search": OP12_SQL,
        "op13_fill_in_middle": OP13_SQL,
    }
