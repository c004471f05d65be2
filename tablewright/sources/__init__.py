"""Reading input tables and run artifacts; writing tables, reports and the run log."""
