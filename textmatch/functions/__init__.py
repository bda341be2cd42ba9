"""Column functions: text, distances, ranking, filters. Built-in expressions unless a module says otherwise."""
