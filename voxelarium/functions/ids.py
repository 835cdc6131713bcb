"""Names of cases and scan files as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxelarium.conventions import (
    CLASS_FOLDER_PATTERN,
    MODALITY_PATTERN,
    PATIENT_PATTERN,
    SEQUENCE_PATTERN,
)


def _match(name: Column, pattern: str, group: int = 1, default: str | None = None) -> Column:
    found = F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))
    return found if default is None else F.coalesce(found, F.lit(default))


def patient_of(name: Column, default: str | None = "?") -> Column:
    return _match(name, PATIENT_PATTERN, 1, default)


def sequence_of(name: Column, default: str | None = "?") -> Column:
    return _match(name, SEQUENCE_PATTERN, 1, default)


def modality_of(name: Column) -> Column:
    """Code after the last dash of a scan file, NULL for other files."""
    return _match(name, MODALITY_PATTERN)


def case_of(path: Column) -> Column:
    """File name in front of its modality code, NULL for other files."""
    return _match(path, r"([^/]+)" + MODALITY_PATTERN)


def class_folder_split(path: Column) -> Column:
    return _match(path, CLASS_FOLDER_PATTERN, 1)


def class_folder_label(path: Column) -> Column:
    return _match(path, CLASS_FOLDER_PATTERN, 2).cast("int")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def shape_text(*sizes: Column) -> Column:
    return F.concat_ws(",", *[s.cast("string") for s in sizes])


def shape_part(text: Column, i: int) -> Column:
    """The i-th size of a shape text, NULL when it has fewer."""
    return F.get(F.split(text, ","), F.lit(i)).cast("int")
