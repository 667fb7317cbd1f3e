"""unhold: Spark jobs that decide which held noncurrent object versions may be
released, over version-level inventories of many buckets and snapshots."""

__version__ = "0.1.0"
