"""Jobs composed of the operators: loading, the wide views, the reports, training."""
