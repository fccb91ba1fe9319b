"""Results that are kept up to date while events arrive."""
