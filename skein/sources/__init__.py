"""Sources and sinks: pages as an OCR service delivers them, rows and assets as JSON."""
