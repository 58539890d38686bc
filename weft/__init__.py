"""weft: validating, transforming and routing semi-structured documents on Spark."""
