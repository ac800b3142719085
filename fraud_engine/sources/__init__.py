from .readers import (
    DatasetCatalog, LoadCache, read_explanations, read_features, read_flagged, read_job_matrix,
    read_or_none, read_report, read_transactions,
)
from .writers import output_name, write_flagged, write_table

__all__ = [
    "DatasetCatalog", "LoadCache", "read_explanations", "read_features", "read_flagged",
    "read_job_matrix", "read_or_none", "read_report", "read_transactions", "output_name",
    "write_flagged", "write_table",
]
