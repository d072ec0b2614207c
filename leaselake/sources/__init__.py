"""Sources and sinks: documents, delimited files, versioned tables, reports."""
