"""Reading the raw lake and payloads, writing the lake, the export and the star tables."""
