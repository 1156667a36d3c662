"""Feed files in, stored tables in and out."""
