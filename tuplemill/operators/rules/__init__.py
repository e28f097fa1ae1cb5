"""Logic rules: terms, parsers, a DataFrame fixpoint and a bounded prover."""
