"""What is compiled before a query runs: class schemas, conditions and rules."""
