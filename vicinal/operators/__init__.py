"""Table operators: indexes, matchers, stores."""
