"""Sources: tables, files and bytes."""
