"""Sample loads and reports over the test tables, each with SQL for a second engine."""
