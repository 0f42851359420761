"""The library run on the driver's tables, with an SQL check for each query."""
