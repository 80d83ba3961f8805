"""Public-transport analytics on Spark: timetables, routing, reach, scenarios and operations as DataFrames."""
