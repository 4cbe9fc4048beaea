"""Column expressions: Column in, Column out, no job, no shuffle."""
