"""Column expressions (JVM-side, whole-stage-codegen friendly)."""

from themescope.functions.text import (  # noqa: F401
    clean_text, dataset_key, preview, html_escape_display, strip_all, percent_1dp,
    year_month, similarity_band, numbered_lines, terms,
)
from themescope.functions.vector import (  # noqa: F401
    as_double_array, dot, norm, l2_normalize, cosine, squared_distance, distance,
)
