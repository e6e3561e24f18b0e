"""Training-data operators: thirteen corpus-scale components and their registered queries."""
