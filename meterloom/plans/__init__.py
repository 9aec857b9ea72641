"""Query plans, the SQL front end and the compiler to DataFrames."""
