"""Explore and wrangle tables of any size with Spark DataFrames."""

from gleanframe.apptypes import ROWID, app_type
from gleanframe.operators.cells import (
    display,
    preview,
    run_sql,
    transform,
    transform_batches,
    transform_groups,
)
from gleanframe.operators.compare import compare
from gleanframe.operators.overview import column_types, overview, schema_overview, sparklines
from gleanframe.operators.paging import Pager
from gleanframe.operators.profile import Profile, profile
from gleanframe.operators.ranks import RankIndex
from gleanframe.operators.substrings import SubstringIndex
from gleanframe.operators.suggest import suggest_values, suggestion_index
from gleanframe.operators.table_query import table_query, table_query_sql
from gleanframe.operators.windows import framed_window
from gleanframe.plans.filters import apply_filters
from gleanframe.sources.datasets import (
    Dataset,
    discover,
    export_csv,
    import_entities,
    load,
    scan,
    with_rowid,
)

__all__ = [
    "ROWID",
    "Dataset",
    "Pager",
    "Profile",
    "RankIndex",
    "SubstringIndex",
    "app_type",
    "apply_filters",
    "column_types",
    "compare",
    "discover",
    "display",
    "export_csv",
    "framed_window",
    "import_entities",
    "load",
    "overview",
    "preview",
    "profile",
    "run_sql",
    "scan",
    "schema_overview",
    "sparklines",
    "suggest_values",
    "suggestion_index",
    "table_query",
    "table_query_sql",
    "transform",
    "transform_batches",
    "transform_groups",
    "with_rowid",
]
