"""Row and group operators: each function takes a DataFrame and returns one."""
