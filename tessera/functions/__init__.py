"""Scalar functions and row comparison as Column builders."""

from .scalar import char_pad, coalesce, nullif, overlaps, position, row_compare, substring, trim  # noqa: F401
