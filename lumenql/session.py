"""Settings that the dialect needs."""

from pyspark.sql import SparkSession

# See the reasons beside each.
CONFS = {
    "spark.sql.ansi.enabled": "true",  # overflow, division by zero and bad casts are errors
    "spark.sql.session.timeZone": "UTC",  # default zones are put into expressions instead
    "spark.sql.caseSensitive": "false",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.adaptive.enabled": "true",
}


def configured(spark: SparkSession) -> SparkSession:
    for k, v in CONFS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark
