"""Metric extraction: source trees to the function table and its summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from defectlens.operators.extraction import analyzed_files, extraction_summary, function_rows, is_indented
from defectlens.operators.function_scan import braced_functions, indented_functions
from defectlens.schemas import FUNCTION_METRICS
from defectlens.session import materialize
from defectlens.sources.code_tree import list_source_files, read_listed_files, relative_paths
from defectlens.sources.tables import write_json, write_table


@dataclass
class ExtractedFunctions:
    functions: DataFrame
    files: DataFrame
    summary: DataFrame


def extract_tree(spark: SparkSession, roots: list[str], base: str | None = None) -> ExtractedFunctions:
    """Reads and scans every file once; the summaries are made from the written function table."""
    listing = materialize(list_source_files(spark, roots), "source_listing")
    indented, braced = listing.where(is_indented("path")), listing.where(~is_indented("path"))
    found = indented_functions(read_listed_files(indented, base)).unionByName(
        braced_functions(read_listed_files(braced, base))
    )
    functions = materialize(function_rows(found), "function_metrics")
    files = analyzed_files(relative_paths(listing.select("path"), base), functions)
    return ExtractedFunctions(functions, files, extraction_summary(files))


def write_extraction(extracted: ExtractedFunctions, folder: str) -> None:
    write_table(extracted.functions, f"{folder}/function_metrics", FUNCTION_METRICS.names)
    write_json(extracted.files, f"{folder}/files")
    write_json(extracted.summary, f"{folder}/summary")
