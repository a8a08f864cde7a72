"""sheetspark: table detection and extraction over spreadsheets, as Spark DataFrames."""

__version__ = "0.1.0"
