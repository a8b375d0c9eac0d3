"""Reading and writing the tables the operators work on."""
