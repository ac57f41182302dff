"""MLlib layer: feature stages, classifiers, evaluation, scoring."""
