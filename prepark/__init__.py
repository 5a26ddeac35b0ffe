"""prepark: data preparation and applied analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (usable with
``df.transform``); small metadata results are returned as DataFrames too, so
nothing but scalars ever passes through the driver. The most used entry
points are re-exported here; everything else lives in the subpackages.
"""

from .operators.clean import (  # noqa: F401
    dedupe, drop_missing, fill_forward_backward, impute, standard_scale, text_fill, three_sigma,
)
from .operators.pii import pii_counts, pii_detect, pii_mask  # noqa: F401
from .operators.profile import (  # noqa: F401
    column_summary, describe, describe_text, field_roles, missing_fraction, quick_summary, summary_stats,
)
from .plans.cleaning import clean_file, clean_records, clean_table  # noqa: F401
from .plans.inspect import inspect  # noqa: F401
from .sources.files import preview, read_table, union_by_name, write_table  # noqa: F401

__version__ = "0.1.0"
