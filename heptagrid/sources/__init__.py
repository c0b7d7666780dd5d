"""Archives, read and written."""
