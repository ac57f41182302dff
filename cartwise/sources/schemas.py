"""Input layouts of the clickstream files (fixed schemas: no inference job).

Fixed values: column names, order and types must equal those of the files.
"""

from pyspark.sql import types as T

EVENTS_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType(), False),
    T.StructField("visitorid", T.StringType(), False),
    T.StructField("event", T.StringType(), False),
    T.StructField("itemid", T.IntegerType(), False),
    T.StructField("transactionid", T.StringType(), True),
])

PROPS_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType(), False),
    T.StructField("itemid", T.IntegerType(), False),
    T.StructField("property", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
])

CATEGORY_SCHEMA = T.StructType([
    T.StructField("categoryid", T.IntegerType(), False),
    T.StructField("parentid", T.IntegerType(), True),
])

# Columns the clean event frame must hold (CSV reading makes all nullable).
EVENT_REQUIRED = ("visitorid", "event", "itemid", "ts")
