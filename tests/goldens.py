"""The study's published results, as the tests use them."""

from forestlens.plans.study_results import (  # noqa: F401
    CATEGORY_COUNTS, CLASS_COUNTS, RF_BASE, RF_BASE_METRICS, RF_BASE_TEST, RF_BASE_TEST_METRICS, RF_BIN200_TEST, RF_BIN200_TEST_METRICS,
    RF_BIN_TEST, RF_BIN_TEST_METRICS, TEST_ROWS, UNSEEN_TEST_ROWS, saved_layout,
)
from forestlens.plans.study_results import cells as parse_cells  # noqa: F401
