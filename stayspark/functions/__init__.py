"""Column expressions shared by the operators; all of them are built-in Catalyst expressions."""
