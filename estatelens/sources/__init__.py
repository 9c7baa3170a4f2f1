"""Getting tables in and out."""

from estatelens.sources.readers import (
    LOAD_ORDER,
    Partitioning,
    conform,
    drop_non_finite,
    jdbc_options,
    normalise_names,
    read_jdbc,
    read_parquet,
    register_views,
    with_load_order,
)
from estatelens.sources.sinks import (
    WorkingTables,
    jdbc_write_options,
    typed,
    with_headings,
    with_units,
    write_jdbc,
    write_table,
)
from estatelens.sources.splitting import quantiles, range_predicates
from estatelens.sources.versions import current

__all__ = [
    "LOAD_ORDER", "Partitioning", "WorkingTables", "conform", "current", "drop_non_finite",
    "jdbc_options", "jdbc_write_options", "normalise_names", "quantiles", "range_predicates",
    "read_jdbc", "read_parquet", "register_views", "typed", "with_headings", "with_load_order", "with_units",
    "write_jdbc", "write_table",
]
