"""DataFrame operators: every function takes a DataFrame and returns one."""
