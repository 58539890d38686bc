"""Reading messages, payloads and results, and writing them."""
