from gridloom.functions.scalars import (
    EPSILON,
    hash_normal,
    hash_uniform,
    is_close,
    is_zero,
    ratio,
    required,
    sign_of,
)

__all__ = [
    "EPSILON",
    "hash_normal",
    "hash_uniform",
    "is_close",
    "is_zero",
    "ratio",
    "required",
    "sign_of",
]
