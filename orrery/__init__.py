"""Features from moving point sets, and the data preparation around them, as lazy Spark plans."""
