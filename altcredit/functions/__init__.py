"""Column-expression helpers; everything here stays inside Catalyst."""
