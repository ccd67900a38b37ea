"""Table schemas and the fixed values of the wire format.

Every table carries ``pair_id``, given once at ingest (``sources.ids``).  Spark
rows have no order, so nothing in this package ever relies on row position.
"""

from pyspark.sql import types as T

# These must equal the published data format byte for byte.
END_OF_FUNCTION = "<|endoftext|>\n"
NO_LOCATIONS = "Empty"
REMOVED_LINE = "EmptyLine"
LINE_JOIN = "<s>"
INSERT_TAG = "A:"
ANCHOR_END = "<endRow>"
LINE_PAD = " "
PROMPT_HEAD = "function:\n"
PROMPT_RESPONSE = "Instruction:\n"
STATUS_MISSING = "IS NAN"
STATUS_ABSENT = "no location"
STATUS_UNCHANGED = "wrong location"
STATUS_ERROR = "error"
STATUS_OK = "ok"
IGNORED_LABEL = -100
MAX_EDIT_LINES = 15
MAX_FUNCTION_CHARS = 4000
INPUT_TOKENS = 2048
LABEL_TOKENS = 500
PROMPT_TOKENS = 1400
SIZE_LIMITS = (5, 10, 20, 30)
TOP_K = (1, 3, 5, 10)

PAIRS = T.StructType([
    T.StructField("pair_id", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("before", T.StringType()),
    T.StructField("after", T.StringType()),
])

PREDICTIONS = T.StructType([
    T.StructField("pair_id", T.LongType(), False),
    T.StructField("locations", T.StringType()),
    T.StructField("injections", T.StringType()),
])

FUNCTION_CORPUS = T.StructType([
    T.StructField("func", T.StringType()),
    T.StructField("target", T.IntegerType()),
    T.StructField("cwe", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("commit_id", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("message", T.StringType()),
])
