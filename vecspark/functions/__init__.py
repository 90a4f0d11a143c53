"""Column expressions (JVM-side, codegen-friendly) used across the library."""

from vecspark.functions.vector import (  # noqa: F401
    as_double_array, cosine_distance, cosine_similarity, dot, l2_norm, l2_normalize,
)
from vecspark.functions.text import py_strip, stripped_length, title_words  # noqa: F401
from vecspark.functions.hashing import gaussian, md5_u32, uniform01  # noqa: F401
