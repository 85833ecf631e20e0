"""Jobs made of several operators, and the helpers they share."""
