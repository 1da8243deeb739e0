"""Column names shared by all operators."""

# The columns that identify one learning curve, in display order.
RUN_KEY = ["dataset", "model", "features", "target", "method", "cni", "balanced", "quantile", "grid"]

# Columns that identify one curve in the viewer table (run key plus the joint label).
CATEGORY_COLUMNS = ["dataset", "features", "target", "model", "confound_label", "method", "cni",
                    "balanced", "quantile", "grid"]

# Accepted confound correction methods.
METHODS = ["correct-x", "correct-y", "correct-both", "with-cni", "only-cni", "matching", "none"]
REGRESSION_METHODS = ["correct-x", "correct-y", "correct-both"]

# Limits.
MAX_CLASSES = 10        # more distinct targets than this make the task a regression
MIN_SET_SIZE = 2        # smallest validation / test set
QUANTILE_DISTINCT = 20  # features with at most this many distinct values stay untransformed
QUANTILE_KNOTS = 1000   # knots of the quantile transform
MIN_DOF = 2             # degrees of freedom needed for a power-law fit

SAMPLE = "sample_id"
PREPARED_SCHEMA = "sample_id BIGINT, data ARRAY<DOUBLE>, mask BOOLEAN"
