"""Column expressions: guards, range rules, series keys, texts and access rules."""
