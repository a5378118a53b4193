"""Table-to-table operators on findings and on the evidence graph."""
