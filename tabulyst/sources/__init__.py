from tabulyst.sources.io import read_csv_rows, read_table, write_table
from tabulyst.sources.schema import (
    approx_size,
    categorical_columns,
    column_roles,
    column_types,
    normalize_missing,
    numeric_columns,
    select_columns,
    table_shape,
    text_columns,
)

__all__ = [
    "read_table", "read_csv_rows", "write_table", "approx_size", "categorical_columns", "column_roles",
    "column_types", "normalize_missing", "numeric_columns", "select_columns", "table_shape", "text_columns",
]
