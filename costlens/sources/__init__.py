"""Export files, schemas, tables and views."""
