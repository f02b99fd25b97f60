"""The queries the driver runs, each with the SQL that states its result where SQL can."""
