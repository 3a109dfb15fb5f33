from gridloom.sources.construct import (
    densify,
    empty_tensor,
    from_arrays,
    from_coo,
    from_vector,
    index_grid,
    random_factors,
    slice_batches,
    slice_window,
)

__all__ = [
    "densify",
    "empty_tensor",
    "from_arrays",
    "from_coo",
    "from_vector",
    "index_grid",
    "random_factors",
    "slice_batches",
    "slice_window",
]
