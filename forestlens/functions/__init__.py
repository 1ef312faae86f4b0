from forestlens.functions.labels import (
    binarize, category_of, cell_opacity, register_binarizer, strip_suffix,
)

__all__ = ["binarize", "category_of", "cell_opacity", "register_binarizer", "strip_suffix"]
