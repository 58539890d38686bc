"""Units over streams: micro-batches with result, retry, dead-letter and event tables."""
