"""Constants and table layouts of a slate log.

Wide form (stored): one row per user, every per-step column an array, padded on
the right with ``PAD``.  Long forms (derived, never stored): one row per
interaction, one row per shown item.
"""

from pyspark.sql import types as T

# Reserved item ids, and the size of the padded arrays.
PAD = 0
NO_CLICK = 1
UNKNOWN = 2
FIRST_REAL = 3
MAX_STEPS = 20
MAX_SLATE = 25

# Phases, their integer mask codes, first held-out step.
PHASES = ("train", "valid", "test")
MASK_CODE = {"train": 1, "valid": 2, "test": 3}
T_SPLIT = 5

STEP_COLUMNS = ("click", "click_idx", "slate_lengths", "interaction_type", "slate")

_ints = T.ArrayType(T.IntegerType())

LOG = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("click", _ints),
    T.StructField("click_idx", _ints),
    T.StructField("slate_lengths", _ints),
    T.StructField("interaction_type", _ints),
    T.StructField("slate", T.ArrayType(_ints)),
])

ITEM = T.StructType([
    T.StructField("item_id", T.IntegerType()),
    T.StructField("category_id", T.IntegerType()),
])

VECTORS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("vec", T.ArrayType(T.DoubleType())),
])

METRIC = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("phase", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
