"""Writers for mail batches, flights and reports."""
