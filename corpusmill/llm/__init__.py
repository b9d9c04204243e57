"""Operators that prepare training text: rules, classifiers, sharding, encoding, joins, scans, scoring and packing."""
