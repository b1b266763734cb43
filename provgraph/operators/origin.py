"""Claims of where a file was downloaded from, from records that a platform keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.functions.text import safe_url

# Weights of the records of each platform.
WEIGHTS = {"windows-zone": 0.78, "chromium-history": 0.66, "macos-xattr": 0.76, "macos-spotlight": 0.68, "linux-xattr": 0.66, "linux-gvfs": 0.58}


def origin_evidence(records: DataFrame) -> DataFrame:
    """Evidence (source_path, target_path, relation, kind, mode, signal_group, weight, url, confidence) of records (path, url, source).

    URLs are stripped of credentials, queries and fragments before anything is kept; records without a
    usable URL and of unknown sources give nothing, and one URL of one source counts once for a path.
    """
    weight = F.lit(None).cast("double")
    for source, w in WEIGHTS.items():
        weight = F.when(F.col("source") == source, w).otherwise(weight)
    clean = records.select("path", safe_url(F.trim(F.regexp_replace("url", "\\x00", ""))).alias("url"), "source", weight.alias("weight")).where("url is not null and weight is not null").distinct()
    key = F.concat(F.lit("@origin/"), F.left(F.sha2("url", 256), F.lit(24)))
    return clean.select(key.alias("source_path"), F.col("path").alias("target_path"), F.lit("downloaded_from").alias("relation"), F.col("source").alias("kind"), F.lit("metadata").alias("mode"), F.lit("download-origin").alias("signal_group"), "weight", "url", F.when(F.col("weight") >= 0.75, "strong").otherwise("moderate").alias("confidence"))
