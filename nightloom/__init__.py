"""nightloom: stacking, grading and planning of sensor-frame bursts as Spark DataFrames."""
