"""Cloud-cost analytics on Spark: billing exports in, cost reports out."""
