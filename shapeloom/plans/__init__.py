"""Driver-side plans: paths, shapes, selectors, rules and SPARQL algebra, and rewrites of them."""
