"""Table operators: declarative transforms."""
