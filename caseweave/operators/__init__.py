"""The analytic operators; every module takes and returns DataFrames."""
