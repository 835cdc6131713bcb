"""File inventories: listings, class folders, expected files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelarium.functions.ids import base_name, class_folder_label, class_folder_split


def scan_inventory(spark: SparkSession, root: str, glob: str = "*.nii.gz") -> DataFrame:
    """Path and size of every matching file below ``root``; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return files.select("path", base_name(F.col("path")).alias("name"), "length")


def inventory_summary(expected: DataFrame, files: DataFrame, root: str = "root") -> DataFrame:
    """Files and bytes of every expected root with status ``missing``, ``empty`` or ``ok``.

    ``files`` carries ``root, length``; a root that exists without files has a
    row with NULL length.
    """
    sums = files.groupBy(root).agg(
        F.count("length").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    )
    status = F.when(F.col("n_files").isNull(), "missing").when(F.col("n_files") == 0, "empty")
    joined = expected.join(sums, root, "left").withColumn("status", status.otherwise("ok"))
    return joined.fillna(0, ["n_files", "bytes"])


def scan_class_folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """Split and class of files laid out as ``split/class/file``; anything else is skipped."""
    p = F.col(path)
    return paths.withColumns({"split": class_folder_split(p), "label": class_folder_label(p)}).where(
        F.col("split").isNotNull()
    )


def locate_with_fallback(expected: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Expected path if listed, else the first listed file of that name, else ``missing``.

    Listed names are reduced to their smallest path first, so a file name with
    many copies cannot multiply the join.
    """
    exact = listing.select(F.col(path).alias("_hit")).distinct()
    named = listing.groupBy(base_name(F.col(path)).alias("_name")).agg(F.min(path).alias("_other"))
    found = (
        expected.withColumn("_name", base_name(F.col(path)))
        .join(exact, F.col(path) == F.col("_hit"), "left")
        .join(named, "_name", "left")
    )
    status = F.when(F.col("_hit").isNotNull(), "ok").when(F.col("_other").isNotNull(), "moved")
    return found.withColumns(
        {"located": F.coalesce("_hit", "_other"), "status": status.otherwise("missing")}
    ).drop("_hit", "_other", "_name")
