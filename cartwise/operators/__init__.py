"""DataFrame -> DataFrame operators: cleaning, items, sessions, labels,
features, splits, reports, scoring and table exploration."""
