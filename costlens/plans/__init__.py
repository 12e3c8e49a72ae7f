"""Named cost reports."""
