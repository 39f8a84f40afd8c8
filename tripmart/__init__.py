"""Trip-booking lakehouse on Spark: sources, operators, layer plans and streams."""
