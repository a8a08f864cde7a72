"""Files: identification, encodings, text and workbook readers."""
