"""Column expressions shared by readers and reports."""
