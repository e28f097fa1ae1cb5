"""Query planning: predicates and the choice of a physical layout."""
