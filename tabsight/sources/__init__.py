"""Reading and writing tables and fitted models."""

from tabsight.sources.io import (  # noqa: F401
    read_table, load_tables, cap_rows, preview, write_results, save_model, load_model,
    union_all_by_name, union_distinct, PANDAS_NA_STRINGS,
)
