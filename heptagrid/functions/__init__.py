"""Column expressions: the codec, the number line, latitudes and distances."""
