"""All registered queries."""

from opinio.plans import calendar, mining, prompting, rows, similarity, stored, streams, tables, textual
from opinio.plans.base import QUERIES, SQL

MODULES = (stored, rows, textual, calendar, tables, mining, similarity, prompting, streams)

#: Lengths, ranks and calendar parts that are int here and bigint in the checker's SQL.
INT_COLUMNS = {
    "A25_best_and_worst": ("rank",),
    "A3_dataset_summary": ("days", "max_length"),
    "D4_calendar_features": ("year", "month"),
    "D9_date_range": ("days",),
    "L2_document_tokens": ("prompt_tokens", "total_tokens"),
    "L2_token_estimate": ("prompt_tokens", "total_tokens"),
    "P10_non_empty_text": ("measured",),
    "P2_fill_missing": ("text_length",),
    "P4_clean_reviews": ("text_length",),
    "P9_text_column_choice": ("chosen_length",),
    "R1_array_functions": ("n_long",),
    "S13_prepare_chain": ("year", "month", "text_length"),
    "S8_normalize_records": ("text_length",),
    "T10_preprocess": ("n_tokens",),
    "T11_text_length": ("text_length",),
    "T12_word_counts": ("word_count",),
    "T4_tokenize": ("n_tokens",),
    "V1_index_documents": ("text_length",),
    "V2_nearest_neighbours": ("rank",),
    "V3_filtered_search": ("rank",),
    "W6_top_n_per_stratum": ("rank",),
}
for _name, _columns in INT_COLUMNS.items():
    _casts = ", ".join(f"cast({c} as int) as {c}" for c in _columns)
    SQL[_name] = f"select * replace ({_casts}) from ({SQL[_name]})"

__all__ = ["MODULES", "QUERIES", "SQL"]
